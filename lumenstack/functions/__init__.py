"""Column functions of the catalog: names, identifiers, scores, faces, geography."""

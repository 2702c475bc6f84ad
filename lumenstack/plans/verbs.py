"""The command surface: each verb and the operators behind it.

A verb is a function of tables and arguments. What needs pixels, a network
service or a screen is no part of this library; ``OUT_OF_SCOPE`` lists it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..operators import browse, facets, jobs, library, locations, matching, people, places, reports, vectors, versions
from ..sources import embedded, listing
from ..streaming import watch
from . import migrations, phases

VERBS: dict[str, Callable[..., Any]] = {
    "init-catalog": migrations.migrate, "scan-raw": embedded.scan, "enrich-raw": browse.to_enrich, "analyze-metadata": reports.coverage,
    "evaluate-ground-truth": reports.evaluation, "export-ground-truth": reports.ground_truth, "resolve-image": matching.resolve, "resolve-export-batch": matching.resolve,
    "watch-images": watch.changed_files, "generate-previews": browse.previews_to_make, "refresh-assets": listing.content_changed, "browse-images": browse.browse,
    "browse-map-points": locations.map_points, "resolve-ai-locations": places.resolve_places, "get-asset-location": locations.location_of, "facet-values": facets.facet_values,
    "search-facet": facets.search_facet, "asset-detail": browse.detail, "list-pending": browse.pending, "confirm-match": matching.confirm,
    "list-collections": library.list_collections, "create-collection": library.create_collection, "update-collection": library.update_collection, "delete-collection": library.delete_collection,
    "collection-add-items": library.add_items, "collection-remove-items": library.remove_items, "set-asset-rating": library.set_rating, "browse-collection": browse.browse_collection,
    "quick-register": versions.attach_to_origins, "collage-sources": versions.collage_sources, "list-repaint-history": versions.repaint_history, "delete-image-assets": library.delete_assets,
    "cleanup-orphan-images": library.clean_orphans, "verify-assets": library.verify, "relink-asset": library.relink, "catalog-roots": library.active_roots, "register-roots": library.upsert_roots,
    "create-job": jobs.create, "get-job": jobs.get, "latest-job": jobs.latest, "cancel-job": jobs.request_cancel, "fail-job": jobs.fail, "pause-job": jobs.request_pause,
    "resume-job": jobs.request_resume, "list-active-jobs": jobs.active, "list-jobs": jobs.latest, "list-people-groups": people.list_groups, "similar-people-groups": vectors.similar_groups,
    "people-group-detail": people.group_detail, "rename-people-group": people.rename, "set-people-group-cover": people.set_cover, "set-people-group-state": people.set_states,
    "set-people-groups-state": people.set_states, "remove-face-from-person": people.remove_faces, "assign-face-to-person": people.assign_faces, "merge-people-groups": people.merge_groups,
    "run-import-job": phases.run_import, "run-enrichment-job": embedded.extract, "run-people-index-job": vectors.candidate_groups, "get-provider-token": library.get_setting,
    "set-provider-token": library.set_setting, "delete-provider-token": library.delete_setting, "repair-resource-sets": versions.split_wrongly_merged, "split-shared-assets": versions.split_shared_assets,
    "summary": reports.summary, "scan-new-media": listing.new_media, "annotate-asset": library.save_annotations, "run-annotation-job": browse.to_annotate, "annotation-count": browse.to_annotate,
    "get-annotation": browse.detail, "clear-ai-location": locations.clear_ai_location, "add-asset-tag": library.add_tag, "remove-asset-tag": library.remove_tag, "list-tags": library.list_tags,
}
OUT_OF_SCOPE = ("benchmark-dataset", "create-derived", "add-text", "serve", "export-assets", "run-preview-job", "run-ai-repaint-job", "run-text-image-job", "list-ai-models", "ai-repaint", "annotation-test-connection", "annotation-list-models")

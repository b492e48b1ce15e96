"""Reports on parsed pages and on what an ingest is ready for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is trimmed from a region's text.
TRIMMED = " \t\n\r\f\x0b\u00a0\ufeff"


def page_audit(pages: DataFrame, regions: DataFrame, assets: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, page_number, n_chars, n_assets, reasons) of pages that need optical character recognition.

    pages and assets have (doc_id, page_number), regions (doc_id, page_number,
    kind, text); regions and assets of unknown pages count for nothing. Reasons
    stand in a fixed order. One shuffle, with partial sums before it.
    """
    page = ["doc_id", "page_number"]
    none, long = F.lit(None).cast("boolean"), F.lit(0).cast("long")
    known = pages.select(*page, F.lit(True).alias("known"), none.alias("image"), long.alias("chars"), long.alias("assets"))
    text = regions.select(*page, none.alias("known"), (F.col("kind") == "page_image").alias("image"), F.coalesce(F.length(F.btrim("text", F.lit(TRIMMED))), F.lit(0)).cast("long").alias("chars"), long.alias("assets"))
    drawn = assets.select(*page, none.alias("known"), none.alias("image"), long.alias("chars"), F.lit(1).cast("long").alias("assets"))
    sums = known.unionByName(text).unionByName(drawn).groupBy(*page).agg(F.max("known").alias("known"), F.coalesce(F.max("image"), F.lit(False)).alias("image"), F.sum("chars").alias("n_chars"), F.sum("assets").alias("n_assets")).where("known")
    n, drawings = F.col("n_chars"), F.col("n_assets") > 0
    reasons = F.array_compact(
        F.array(
            F.when(drawings & (n == 0), "page_has_visual_asset_without_text"),
            F.when(F.col("image") & (n == 0), "page_has_page_image_region_without_text"),
            F.when(n == 0, "layout_page_without_text"),
            F.when((drawings | F.col("image")) & (n > 0) & (n < least), "page_text_below_threshold"),
        )
    )
    return sums.select(*page, "n_chars", "n_assets", reasons.alias("reasons")).where(F.size("reasons") > 0)


def readiness(counts: DataFrame) -> DataFrame:
    """Counts of ingests with what each is ready for and its sorted warnings.

    Counts that are not there, or null, are 0: n_chunks, n_body_chunks,
    n_layouts, n_ocr_pages, n_parser_warnings, n_artifact_warnings,
    n_relationships, n_vectors, n_visual_vectors, n_entities, n_relations.
    post_status is the status of what followed, where it is known.
    """

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in counts.columns else F.lit(0)

    status = F.coalesce(F.col("post_status"), F.lit("")) if "post_status" in counts.columns else F.lit("")
    graph = (n("n_entities") > 0) | (n("n_relations") > 0)
    warnings = F.array_compact(
        F.array(
            F.when(n("n_relationships").eqNullSafe(0) & (n("n_chunks") > 1), "connected_chunk_relationships_missing"),
            F.when((n("n_layouts") > 0) & (n("n_chunks") == n("n_body_chunks")), "derived_searchable_units_empty"),
            F.when(~graph, "graph_knowledge_empty"),
            F.when(n("n_ocr_pages") > 0, "pages_need_ocr"),
            F.when(n("n_parser_warnings") > 0, "parser_quality_warnings"),
            F.when(status.isin("failed", "partial"), F.concat(F.lit("post_ingest_"), status)),
            F.when(n("n_artifact_warnings") > 0, "searchable_artifact_warnings"),
            F.when(n("n_chunks") == 0, "text_index_empty"),
            F.when(n("n_vectors") == 0, "vector_index_empty"),
            F.when(n("n_visual_vectors") == 0, "visual_index_empty"),
        )
    )
    return counts.withColumns({
        "text_ready": n("n_chunks") > 0, "vector_ready": n("n_vectors") > 0, "visual_ready": n("n_visual_vectors") > 0,
        "graph_ready": graph, "expansion_ready": n("n_relationships") > 0, "warnings": F.array_sort(warnings),
    })

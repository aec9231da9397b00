"""Queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import queries_cases as cases
from caseloom.llm import queries_documents as documents
from caseloom.llm import queries_vectors as vectors
from caseloom.llm.oracle import ORACLE as ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(module, name)
    for module, names in (
        (cases, ("p1_found", "p1_balanced", "p2_found", "p2_links", "p2_groups", "p4_found", "p4_shares")),
        (vectors, ("p3_found", "p3_neighbors", "p5_found", "p5_top", "p5_row_groups")),
        (documents, ("p6_ids", "p6_counts", "p7_found", "p7_report", "p7_mix", "p8_found", "p8_statistics")),
    )
    for name in names
}

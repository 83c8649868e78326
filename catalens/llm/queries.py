"""The queries of the llm operators, with production parameters over whole tables, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalens.llm import clusters, encoding, leakage, ocr, packing, secrets, spam, truncation
from catalens.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: clusters.close_pairs(table(s, d, "images")),
        "p1_clusters": lambda s, d: clusters.cluster_report(table(s, d, "images")),
        "p2_found": lambda s, d: ocr.page_noise(table(s, d, "ocr")),
        "p2_repaired": lambda s, d: ocr.repaired_pages(table(s, d, "ocr")),
        "p3_found": lambda s, d: secrets.credential_lines(table(s, d, "document_meta")),
        "p3_redacted": lambda s, d: secrets.redacted_files(table(s, d, "document_meta")),
        "p4_found": lambda s, d: truncation.truncated(table(s, d, "analyses")).select("id"),
        "p4_share": lambda s, d: truncation.truncation_share(table(s, d, "analyses")),
        "p5_found": lambda s, d: encoding.garbled_files(table(s, d, "document_meta")),
        "p5_restored": lambda s, d: encoding.restored_files(table(s, d, "document_meta")),
        "p6_packing": lambda s, d: packing.packed(table(s, d, "documents")),
        "p6_fill": lambda s, d: packing.fill_report(packing.packed(table(s, d, "documents"))),
        "p7_found": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "benchmark")).select("doc_id", "item_id"),
        "p7_spans": lambda s, d: leakage.leaks(table(s, d, "documents"), table(s, d, "benchmark")),
        "p8_found": lambda s, d: spam.stuffed_documents(table(s, d, "documents")).select("doc_id"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            with i as (select distinct file_id, phash from images where phash is not null and phash <> 0)
            select distinct a.file_id as file_id_a, b.file_id as file_id_b
            from i a join i b on a.file_id < b.file_id and bit_count(xor(a.phash, b.phash)) <= 8
        """,
    }

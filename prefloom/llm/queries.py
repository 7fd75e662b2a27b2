"""The pN_ queries: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm.cross_split import cross_split_overlaps, overlap_links, overlap_report
from prefloom.llm.languages import document_languages, mislabelled
from prefloom.llm.leakage import leak_report, leaked_items
from prefloom.llm.near_duplicates import near_duplicate_groups
from prefloom.llm.packing import pack, packing_report, token_counts
from prefloom.llm.pair_defects import pair_defects
from prefloom.llm.reading_level import level_profile, unsuited_levels
from prefloom.llm.truncation import truncated_fields, truncation_report
from prefloom.llm.varied_subset import varied_subsets
from prefloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a test sample that are the same or nearly so."""
    pairs = cross_split_overlaps(table(spark, sf_dir, "samples"))
    return pairs.select(
        F.least("train_id", "test_id").alias("sample_id_a"), F.greatest("train_id", "test_id").alias("sample_id_b")
    ).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping samples for each split and source."""
    rows = table(spark, sf_dir, "samples")
    return overlap_report(rows, *overlap_links(rows))


def p2_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied subset of each request."""
    return varied_subsets(table(spark, sf_dir, "samples"), table(spark, sf_dir, "subset_requests"), table(spark, sf_dir, "tasks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose text is cut off."""
    return truncated_fields(table(spark, sf_dir, "samples")).select("sample_id", "field")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field."""
    rows = table(spark, sf_dir, "samples")
    return truncation_report(rows, truncated_fields(rows))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of near-duplicate prompts."""
    return near_duplicate_groups(table(spark, sf_dir, "samples"), "sample_id", "prompt")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are no proper answer, with their defects."""
    return pair_defects(table(spark, sf_dir, "samples"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose chosen text doesn't suit the reader their task names."""
    samples, tasks, examples = (table(spark, sf_dir, t) for t in ("samples", "tasks", "level_examples"))
    return unsuited_levels(samples, tasks, examples).select("sample_id", "reading_level")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading levels of each dataset's chosen texts."""
    return level_profile(table(spark, sf_dir, "samples"), table(spark, sf_dir, "level_examples"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for each capacity."""
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "pack_sizes"), "doc_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing_report(p7_packing(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they hold."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each evaluation item leaked."""
    items = table(spark, sf_dir, "eval_items")
    return leak_report(leaked_items(table(spark, sf_dir, "documents"), items), items)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of mixed documents and of documents with a missing or wrong label."""
    return mislabelled(document_languages(table(spark, sf_dir, "documents"))).select("doc_id", "seg_no", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every document with its language and confidence."""
    return document_languages(table(spark, sf_dir, "documents")).withColumn("confidence", F.round("confidence", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_report, p2_subsets, p3_found, p3_report, p4_found, p5_found, p6_found, p6_profile, p7_packing, p7_report, p8_found, p8_report, p9_found, p9_languages)
    return {f.__name__: f for f in names}


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_ONE = "o AS (SELECT sample_id, split, prompt, chosen, rejected FROM samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at)=1)"


def _likeness(fields: tuple[str, ...], cross: bool) -> str:
    """Pairs whose word pairs are alike to 0.6 or more, by counting shared word pairs of all rows."""
    lists = " UNION ALL ".join(f"SELECT sample_id, split, {_WORDS.format(f)} AS w FROM o WHERE {f} IS NOT NULL" for f in fields)
    side = " AND a.split <> b.split" if cross else ""
    return (
        f"{_ONE}, l AS ({lists}), g AS (SELECT DISTINCT sample_id, split, w[i] AS x, w[i+1] AS y FROM (SELECT sample_id, split, w, unnest(generate_series(1, len(w)-1)) AS i FROM l WHERE len(w) > 1)),"
        " n AS (SELECT sample_id, count(*) AS n FROM g GROUP BY 1),"
        f" c AS (SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS c FROM g a JOIN g b ON a.x=b.x AND a.y=b.y AND a.sample_id < b.sample_id{side} GROUP BY ALL),"
        " e AS (SELECT a, b FROM c JOIN n p ON p.sample_id=a JOIN n q ON q.sample_id=b WHERE c >= 0.6::double*(p.n+q.n-c) - 1e-9)"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_likeness(('prompt', 'chosen', 'rejected'), True)} SELECT a AS sample_id_a, b AS sample_id_b FROM e",
        "p4_found": f"WITH RECURSIVE {_likeness(('prompt',), False)}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),"
        " r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON r.node=s.a) SELECT node AS sample_id, min(root) AS group_id FROM r GROUP BY 1",
    }

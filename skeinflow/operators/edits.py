"""Edits of annotated elements: by hand, by regeneration, by restoring a revision; each appends a revision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lifecycle import append_revisions
from .versions import first_per

TEXTS, LISTS = ("summary", "classification"), ("keywords", "tags")
FIELDS = (*TEXTS, *LISTS)


def _clean(name: str, c: Column) -> Column:
    return X.clean_list(c) if name in LISTS else X.blank_to_null(c)


def changes(elements: DataFrame, wanted: DataFrame, fields: Sequence[str] = FIELDS, keep_null: bool = True) -> DataFrame:
    """Elements that `wanted` (id and fields) changes, with their new values and column `updated_fields`.

    A null keeps what is there (unless not `keep_null`), a blank text clears it; lists are trimmed and made
    distinct. Elements with nothing changed, and ids that don't exist, give no row.
    """
    asked = wanted.select("id", *[F.col(f).alias(f"_w_{f}") for f in fields])
    both = elements.join(asked, "id")
    new = {f: _clean(f, F.col(f"_w_{f}")) for f in fields}
    if keep_null:
        new = {f: F.when(F.col(f"_w_{f}").isNull(), F.col(f)).otherwise(v) for f, v in new.items()}
    named = both.select("*", *[v.alias(f"_n_{f}") for f, v in new.items()])
    listed = X.changed_fields({f: (F.col(f), F.col(f"_n_{f}")) for f in fields}, LISTS)
    changed = named.withColumn("updated_fields", listed).where(F.size("updated_fields") > 0)
    kept = [F.col(f"_n_{c}").alias(c) if c in fields else F.col(c) for c in elements.columns]
    return changed.select(*kept, "updated_fields")


def apply(elements: DataFrame, changed: DataFrame, override: bool = True) -> DataFrame:
    """`elements` with the changed rows in place; they are marked as overridden by a user, or as not."""
    marks = {"user_override_active": F.lit(override), "new_ai_available": F.lit(False)}
    put = changed.select(*[marks.get(c, F.col(c)).alias(c) for c in elements.columns])
    return elements.join(changed.select("id"), "id", "left_anti").select(*elements.columns).unionByName(put)


def record(revisions: DataFrame, changed: DataFrame, source: str) -> DataFrame:
    """New revisions of the changed elements. `source` is AI, USER or REGENERATE."""
    rows = changed.select(F.col("id").alias("element_id"), *FIELDS, "updated_fields", F.lit(source).alias("source"))
    return append_revisions(revisions, rows, "element_id", F.col("element_id"))


def history(revisions: DataFrame, element_id: object) -> DataFrame:
    return revisions.where(F.col("element_id") == element_id).orderBy(F.col("revision").desc_nulls_last())


def latest_revision(revisions: DataFrame) -> DataFrame:
    return first_per(revisions, ["element_id"], F.col("revision").desc_nulls_last())


def restore(elements: DataFrame, revisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Changes that bring back revisions (element_id, revision); the revision's nulls count as values."""
    rows = revisions.join(wanted, ["element_id", "revision"]).select(F.col("element_id").alias("id"), *FIELDS)
    return changes(elements, rows, keep_null=False)


def sync_sections(sections: DataFrame, changed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sections of changed elements take the new values; `key` names the columns that join them."""
    new = first_per(changed, key, F.col("id").desc_nulls_last()).select(*key, *[F.col(f).alias(f"_n_{f}") for f in FIELDS], F.lit(True).alias("_hit"))
    joined = sections.join(new, list(key), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in sections.columns])

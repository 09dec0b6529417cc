"""The table as users see it: one object over a stored path. Writers decide on one version and publish the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embed import Embedder, embed_missing, tried
from .operators import aggregates, lines, ordering, search
from .plans import dedup, merge
from .plans.admission import admit_batch, admitted_rows
from .schema import DEDUP_THRESHOLD, GROUP_KEYS, TIMELINE_LIMIT
from .session import materialize
from .sources import exports, jsonl, keyword_index, memory_files, snapshots, table

Result = TypeVar("Result")
# How often a write decides anew after another writer came first.
ATTEMPTS = 5


class NoteTable:
    """Notes stored at ``path``. Reads give DataFrames; the four writers say what they did."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self, role: str | None = None, category: str | None = None, *, snapshot: snapshots.Snapshot | None = None) -> DataFrame:
        """Stored rows of the newest version, or of ``snapshot``; an absent table counts as empty."""
        return table.scan_entries(self.spark, self.path, role, category, snapshot=snapshot)

    def snapshot(self) -> snapshots.Snapshot:
        return snapshots.current(self.spark, self.path)

    def vacuum(self, *, keep: int = 2, unless_younger_than: float = 24 * 3600.0) -> list[str]:
        """Delete files that only older versions or writes that broke off hold."""
        return snapshots.vacuum(self.spark, self.path, keep=keep, unless_younger_than=unless_younger_than)

    def _decided(self, write: Callable[[snapshots.Snapshot], Result]) -> Result:
        """Run a write that decides on one version; if another writer came first, decide anew."""
        for _ in range(ATTEMPTS - 1):
            try:
                return write(self.snapshot())
            except snapshots.Conflict:
                continue
        return write(self.snapshot())

    # Reading

    def count(self, role: str, category: str) -> int:
        return self.entries(role, category).count()

    def categories(self, role: str) -> DataFrame:
        return aggregates.list_categories(self.entries(), role)

    def search(
        self, role: str, category: str, query: str, vector: Sequence[float] | None = None,
        tag: str | None = None, limit: int | None = None, *, embed: Embedder | None = None,
    ) -> DataFrame:
        """Without a vector, ``embed`` gives the query's; if it fails, keywords decide."""
        if vector is None and embed is not None:
            (vector,) = tried(embed, [query])
        return search.hybrid_search(self.entries(role, category), role, category, query, vector, tag, limit, index=self.keyword_index())

    def search_all(self, queries: DataFrame, *, embed: Embedder | None = None) -> DataFrame:
        if embed is not None:
            queries = embed_missing(queries, embed, text="query")
        return search.batch_search(self.entries(), queries, index=self.keyword_index())

    def timeline(
        self, role: str, last: str | None = None, category: str | None = None, limit: int = TIMELINE_LIMIT,
        *, as_of: date | str,
    ) -> DataFrame:
        return ordering.timeline(self.entries(role), role, last, category, limit, as_of=as_of)

    def export_markdown(self, role: str, category: str | None = None) -> DataFrame:
        return exports.export_markdown(self.entries(), role, category).orderBy(*exports.MARKDOWN_ORDER)

    def export_json(self, role: str, category: str | None = None) -> DataFrame:
        return exports.export_json(self.entries(), role, category).orderBy("role", *ordering.EXPORT_ORDER)

    def stats(self, role: str | None = None) -> DataFrame:
        return aggregates.stats_totals(self.entries(), role)

    def stats_by_category(self, role: str | None = None) -> DataFrame:
        return aggregates.stats_by_category(self.entries(), role)

    def size(self) -> DataFrame:
        return aggregates.storage_size(self.entries())

    def health(self) -> DataFrame:
        return aggregates.embedding_health(self.entries())

    def check_folder(self, folder: str) -> DataFrame:
        return lines.check_files(memory_files.read_memory_files(self.spark, folder))

    def fix_folder(self, folder: str, target: str) -> DataFrame:
        """Prune the files of ``folder`` into the new folder ``target``, which can be read and checked like the old one. Returns the report."""
        found = materialize(memory_files.read_memory_files(self.spark, folder), "lines")
        memory_files.write_memory_files(lines.fixed_lines(found), target)
        return lines.fix_files(found)

    def keyword_index(self) -> keyword_index.KeywordIndex | None:
        return keyword_index.read_keyword_index(self.spark, f"{self.path}/_keywords")

    # Writing

    def index_keywords(self) -> None:
        """List the trigrams of all entries; keyword searches then read the entries that the lists name, and later ones."""
        keyword_index.write_keyword_index(self.entries(), f"{self.path}/_keywords")

    def _last_id(self, snapshot: snapshots.Snapshot) -> int:
        return self.entries(snapshot=snapshot).agg(F.max("id")).first()[0] or 0

    def store(
        self, incoming: DataFrame, threshold: float = DEDUP_THRESHOLD, *, embed: Embedder | None = None,
        as_of: date | str | None = None,
    ) -> DataFrame:
        """Admit a batch in ``id`` order, append what is new under new ids, return every verdict.

        ``as_of`` dates rows without ``created_at``, ``embed`` gives rows without one their vector.
        """
        if as_of is not None:
            dated = F.col("created_at") if "created_at" in incoming.columns else F.lit(None)
            incoming = incoming.withColumn("created_at", F.coalesce(dated.cast("string"), F.lit(str(as_of))))
        elif "created_at" not in incoming.columns:
            raise ValueError("rows without created_at need as_of")
        if "embedding" not in incoming.columns:
            incoming = incoming.withColumn("embedding", F.lit(None).cast("array<float>"))
        if embed is not None:
            incoming = materialize(embed_missing(incoming, embed), "embedded")

        def admit(now: snapshots.Snapshot) -> DataFrame:
            verdict = materialize(admit_batch(incoming, self.entries(snapshot=now), threshold), "verdict")
            fresh = ordering.with_next_ids(admitted_rows(verdict), ["id"], self._last_id(now))
            table.append_entries(fresh, self.path, base=now)
            return verdict

        return self._decided(admit)

    def collect_garbage(
        self, role: str, category: str | None = None, threshold: float = DEDUP_THRESHOLD, *, dry_run: bool = True
    ) -> DataFrame:
        """Duplicates of a role; unless a dry run, rewrite the directories that held any."""

        def clean(now: snapshots.Snapshot) -> DataFrame:
            rows = self.entries(role, category, snapshot=now)
            found = materialize(dedup.dedup_find(rows, threshold), "duplicates")
            if not dry_run and not found.isEmpty():
                touched = found.select(*GROUP_KEYS).distinct()
                left = dedup.dedup_apply(rows.join(touched, list(GROUP_KEYS), "left_semi"), found)
                table.replace_partitions(left, self.path, base=now)
            return found

        return self._decided(clean)

    def import_tree(
        self, root: str, embed: Embedder | None = None, *, as_of: date | str, dry_run: bool = False
    ) -> DataFrame:
        """Import a JSON-lines tree once; a repeated import adds nothing. Returns the summary.

        Without an embedder the rows are stored without vectors.
        """

        def merged(now: snapshots.Snapshot) -> DataFrame:
            records = jsonl.read_jsonl_memories(self.spark, root, as_of)
            stored = self.entries(snapshot=now)
            fresh = materialize(merge.merge_jsonl(records, stored), "fresh")
            files = jsonl.list_jsonl_files(self.spark, root)
            if dry_run:
                return merge.merge_summary(records, fresh.limit(0), files, stored)
            summary = materialize(merge.merge_summary(records, fresh, files, stored), "summary")
            rows = ordering.with_next_ids(fresh, ["path", "position"], self._last_id(now))
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
            table.append_entries(merge.rebuild_embeddings(rows, embed) if embed else rows, self.path, base=now)
            return summary

        return self._decided(merged)

    def rebuild(self, embed: Embedder | None = None, *, dry_run: bool = False) -> DataFrame:
        """Fill in missing vectors, rewriting only directories that lack some.

        Returns per group how many rows were pending, and after a run how many were filled and how many remain.
        """

        def filled(now: snapshots.Snapshot) -> DataFrame:
            stored = self.entries(snapshot=now)
            pending = materialize(merge.rebuild_report(stored), "pending")
            if dry_run or embed is None or pending.isEmpty():
                return pending.withColumn("remaining", F.col("pending")).withColumn("filled", F.lit(0).cast("bigint"))
            touched = stored.join(pending.select(*GROUP_KEYS), list(GROUP_KEYS), "left_semi")
            rebuilt = materialize(merge.rebuild_embeddings(touched, embed), "rebuilt")
            table.replace_partitions(rebuilt, self.path, base=now)
            left = rebuilt.where("embedding is null").groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("remaining"))
            report = pending.join(left, list(GROUP_KEYS), "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
            return report.withColumn("filled", F.col("pending") - F.col("remaining"))

        return self._decided(filled)

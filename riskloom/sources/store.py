"""The case table: Parquet, partitioned by fraud type, written in batches and compacted in generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..files import Folder
from ..functions.vectors import embedding_text, hash_vector, norm2, space_name
from ..operators.dedup import content_key, first_per_key, last_per_key, unseen
from ..schemas import CASE_TABLE, RiskOptions


def with_vectors(cases: DataFrame, options: RiskOptions = RiskOptions()) -> DataFrame:
    """Adds the vector of each case, its squared length and the name of its space."""
    text = embedding_text(*[F.col(c) for c in ("fraud_type", "scenario", "summary", "fraud_script", "key_risk_signals")])
    return cases.withColumn("vec", hash_vector(text, options.dim)).withColumns(
        {"norm2": norm2(F.col("vec")), "space": F.lit(space_name(options.dim))}
    )


def new_cases(cases: DataFrame, known: DataFrame | None, order: Column) -> DataFrame:
    """Cases to add: hash not stored yet, and the first of each hash within the batch.

    The known-hash exclusion comes first: it drops rows before anything is grouped.
    """
    fresh = cases if known is None else unseen(cases, known)
    return first_per_key(fresh, content_key(F.col("raw_text_hash"), F.col("case_id")), order)


def replace_by_id(stored: DataFrame) -> DataFrame:
    """Current state of an appended table: the latest batch wins per case id."""
    return last_per_key(stored, F.col("case_id"), F.struct("batch_id", "raw_text_hash"))


class CaseStore:
    """The case table at a path, written in batches. Reads are plain DataFrames.

    * `cases/gen=N` holds each case once, by fraud type; `changed/gen=N` the versions that came in their place
      since. A read leaves out of the first what the second has, which is small; so nothing is regrouped.
    * `compact` writes the next generation. It counts once its mark stands in `done`; a generation
      without a mark is of a writer that was lost, and is never read.
    * `totals` holds what every batch added to each fraud type (or took from it), so statistics read no case.
      While a batch is written its mark stands in `open`; if one is left, the totals are counted anew.

    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, options: RiskOptions = RiskOptions()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._files = Folder(spark, path)

    # --- reading

    def exists(self) -> bool:
        return self._files.has(self._base())

    def _generation(self) -> int:
        return max((int(n) for n in self._files.names("done")), default=0)

    def _base(self) -> str:
        return f"cases/gen={self._generation()}"

    def _changed(self) -> str:
        return f"changed/gen={self._generation()}"

    def _table(self, name: str) -> DataFrame:
        if not self._files.has(name):
            return self.spark.createDataFrame([], CASE_TABLE)
        return self.spark.read.schema(CASE_TABLE).parquet(f"{self.path}/{name}")

    def read(self, only: Column | None = None) -> DataFrame:
        """All stored cases, of replaced ones the latest version.

        `only` is a condition on case_id that reaches every scan. Without replacements a filter
        on fraud_type reads only that partition.
        """
        rows = lambda name: self._table(name) if only is None else self._table(name).filter(only)
        if not self._files.has(self._changed()):
            return rows(self._base())
        changed = rows(self._changed())
        return rows(self._base()).join(changed.select("case_id"), "case_id", "left_anti").unionByName(replace_by_id(changed))

    def count(self) -> int:
        return self._totals().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def get(self, case_id: str) -> DataFrame:
        """The case of that id; no row if there is none. Bloom filters on ids skip row groups."""
        return self.read(F.col("case_id") == case_id)

    def lookup(self, ids: DataFrame) -> DataFrame:
        """`ids(case_id)` with the stored case next to each and a `found` flag."""
        return lookup_cases(ids, self.read())

    def stats(self) -> DataFrame:
        """Cases per fraud type, with the total on every row; from the batches' totals, not from cases."""
        per_type = self._totals().groupBy("fraud_type").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
        return _with_total(per_type)

    def _totals(self) -> DataFrame:
        if self._files.names("open"):  # a batch was cut short
            for number in self._files.names("totals"):
                self._files.drop(f"totals/{number}")
            self._write_totals(self.read(), "recount")
            for number in self._files.names("open"):
                self._files.drop(f"open/{number}")
        if not self._files.names("totals"):
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).option("recursiveFileLookup", "true").parquet(f"{self.path}/totals")

    # --- writing

    def _next_batch(self) -> int:
        last = [self._table(name).agg(F.max("batch_id")).first()[0] for name in (self._base(), self._changed()) if self._files.has(name)]
        return max((n for n in last if n is not None), default=-1) + 1

    def append(self, cases: DataFrame, order: Column, batch: int | None = None, all_new: bool = False) -> DataFrame:
        """Add the cases not stored yet, with their vectors. Returns the rows added.

        Every call is a batch, and its rows are read back by its number, so nothing is
        computed twice. Running the same input again adds nothing: its hashes are known by
        then; `all_new` says that the caller has left out known hashes. The number is the
        next one, unless the caller hands out numbers.
        """
        known = self.read().select("raw_text_hash") if self.exists() and not all_new else None
        number = self._next_batch() if batch is None else batch
        self._files.make(f"open/{number}")
        added = self._write(new_cases(cases, known, order), number, self._base())
        self._write_totals(added, str(number))
        self._files.drop(f"open/{number}")
        return added

    def replace(self, cases: DataFrame, batch: int | None = None) -> DataFrame:
        """Store cases in place of those with the same id; others are added. One row per id in `cases`."""
        number = self._next_batch() if batch is None else batch
        self._files.make(f"open/{number}")
        if not self.exists():
            self._write(cases.limit(0), number, self._base())
        done = self._write(cases, number, self._changed())
        before = self.read_before(number).join(done.select("case_id"), "case_id", "left_semi")
        gone = before.groupBy("fraud_type").agg((-F.count(F.lit(1))).alias("n"))
        new = done.groupBy("fraud_type").agg(F.count(F.lit(1)).alias("n"))
        new.unionByName(gone).select("fraud_type", "n").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{number}")
        self._files.drop(f"open/{number}")
        return done

    def read_before(self, batch: int) -> DataFrame:
        """The cases as they were before a batch of this generation."""
        changed = self._table(self._changed()).filter(F.col("batch_id") < batch)
        base = self._table(self._base()).filter(F.col("batch_id") < batch)
        return base.join(changed.select("case_id"), "case_id", "left_anti").unionByName(replace_by_id(changed))

    def compact(self) -> None:
        """Write all cases, each once, as a new generation; readers of the old one are not disturbed.

        What a compaction that was cut short has left is overwritten. `vacuum` removes what is no longer read.
        """
        target = self._generation() + 1
        self._save(self.read(), f"cases/gen={target}", "overwrite")
        self._files.make(f"done/{target}")

    def vacuum(self) -> None:
        """Remove the folders of earlier generations, when nothing reads them any more."""
        now = self._generation()
        for kind in ("cases", "changed"):
            for name in self._files.names(kind):
                if int(name.split("=")[1]) < now:
                    self._files.drop(f"{kind}/{name}")

    def _write(self, cases: DataFrame, batch: int, name: str) -> DataFrame:
        dims = self._space()
        if dims not in (None, space_name(self.options.dim)):
            raise ValueError(f"stored vectors are of space {dims}, new ones of {space_name(self.options.dim)}")
        fresh = with_vectors(cases, self.options).withColumns(
            {"batch_id": F.lit(batch).cast("bigint"), "created_at": F.current_timestamp()}
        )
        self._save(fresh, name, "append")
        return self._table(name).filter(F.col("batch_id") == batch)

    def _save(self, cases: DataFrame, name: str, mode: str) -> None:
        columns = T.StructType.fromDDL(CASE_TABLE).names
        # Adaptive execution sizes the files and splits a crowded type over several tasks.
        # Ids and hashes are hashes themselves: only a bloom filter lets a lookup skip row groups.
        writer = cases.select(*columns).hint("rebalance", "fraud_type").write.mode(mode).partitionBy("fraud_type")
        for column in ("case_id", "raw_text_hash"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.path}/{name}")

    def _write_totals(self, cases: DataFrame, name: str) -> None:
        cases.groupBy("fraud_type").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{name}")

    def _space(self) -> str | None:
        for name in (self._base(), self._changed()):
            row = self._table(name).select("space").first() if self._files.has(name) else None
            if row:
                return row["space"]
        return None


TOTALS = "fraud_type string, n bigint"


def lookup_cases(ids: DataFrame, cases: DataFrame) -> DataFrame:
    return ids.join(cases.withColumn("found", F.lit(True)), "case_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def stats_by_type(cases: DataFrame) -> DataFrame:
    """Cases per fraud type, with the total on every row, counted from the cases."""
    return _with_total(cases.groupBy("fraud_type").agg(F.count(F.lit(1)).alias("n")))


def _with_total(per_type: DataFrame) -> DataFrame:
    """At most one row per type is joined."""
    total = per_type.agg(F.sum("n").alias("total"))
    return per_type.select("fraud_type", "n", F.lit(1).alias("_one")).join(
        F.broadcast(total.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")

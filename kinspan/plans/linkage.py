"""Composite plans: the candidate generator with reusable targets, and resumable jobs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators import retrieval


@dataclass(frozen=True)
class Channel:
    enabled: bool = False
    k: int = 5
    most_df: int = 10
    rarest: int = 3


@dataclass(frozen=True)
class Config:
    """Channels other than the exact rules are off unless switched on."""

    name_word: Channel = field(default_factory=Channel)
    address_word: Channel = field(default_factory=Channel)
    rare_token: Channel = field(default_factory=Channel)
    numeric: Channel = field(default_factory=lambda: Channel(most_df=50))
    budgets: tuple[int, ...] = (3, 5, 8, 10, 12, 15)

    @classmethod
    def everything(cls) -> Config:
        on = Channel(enabled=True)
        return cls(on, on, on, Channel(enabled=True, most_df=50))

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Settings from a JSON file, such as {"name_word": {"enabled": true, "k": 10}, "budgets": [3, 15]}; an unknown name is an error."""
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        made = {}
        for name, value in given.items():
            if name not in cls.__dataclass_fields__:
                raise ValueError(f"unknown setting {name}")
            made[name] = tuple(value) if name == "budgets" else Channel(**({"most_df": 50} if name == "numeric" else {}) | value)
        return cls(**made)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


class TargetContext:
    """The target records of all sources and countries with the indexes over them, kept for many batches of S1 records.

    An index is built when a channel first asks for it; ``built`` lists those
    that are, so a second batch adds none.
    """

    def __init__(self, targets: DataFrame) -> None:
        self.targets = targets.where(F.col("source") != "S1").persist()
        self._kept: dict[tuple, tuple[DataFrame, ...]] = {}

    def _index(self, key: tuple, make) -> tuple[DataFrame, ...]:
        if key not in self._kept:
            made = make()
            self._kept[key] = tuple(x.persist() for x in (made if isinstance(made, tuple) else (made,)))
        return self._kept[key]

    def tfidf(self, column: str) -> tuple[DataFrame, DataFrame]:
        return self._index(("tfidf", column), lambda: retrieval.tfidf_index(self.targets, column))

    def tokens(self, column: str, most: int) -> DataFrame:
        return self._index(("tokens", column, most), lambda: retrieval.token_index(self.targets, column, most))[0]

    @property
    def built(self) -> tuple[tuple, ...]:
        return tuple(self._kept)

    def summary(self) -> DataFrame:
        return self.targets.groupBy("source", "country").agg(F.count("*").alias("records"), F.count_distinct("name_norm_clean").alias("names"))

    def countries(self) -> DataFrame:
        return self.targets.select("country").distinct()

    def sources(self) -> DataFrame:
        return self.targets.select("source").distinct()

    def has(self, source: str, country: str) -> bool:
        return not self.get(source, country).isEmpty()

    def get(self, source: str, country: str) -> DataFrame:
        return self.targets.where((F.col("source") == source) & (F.col("country") == country))

    def release(self) -> None:
        for x in (self.targets, *(x for kept in self._kept.values() for x in kept)):
            x.unpersist()
        self._kept.clear()


def reads_kept_tables(df: DataFrame) -> int:
    """How many times the plan of ``df`` reads a kept table instead of building it."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")


class CandidateGenerator:
    def __init__(self, config: Config) -> None:
        self.config = config

    def generate(self, s1: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
        """The evidence union of ``s1`` with the given sources."""
        s1 = s1.withColumn("source", F.lit("S1"))
        others = None
        for name, df in targets.items():
            named = df.withColumn("source", F.lit(name))
            others = named if others is None else others.unionByName(named, allowMissingColumns=True)
        if others is None:
            return retrieval.union_evidence([], s1.sparkSession)
        return self._union(s1, others, lambda column: retrieval.tfidf_index(others, column), lambda column, most: retrieval.token_index(others, column, most))

    def generate_with_context(self, s1: DataFrame, context: TargetContext) -> DataFrame:
        """The same from the kept targets and indexes."""
        return self._union(s1.withColumn("source", F.lit("S1")), context.targets, context.tfidf, context.tokens)

    def _union(self, s1: DataFrame, targets: DataFrame, tfidf, tokens) -> DataFrame:
        c = self.config
        records = s1.unionByName(targets, allowMissingColumns=True)
        channels = [retrieval.channel(retrieval.exact_flags(records).drop("exact_count"), "retrieved_exact")]
        for name, column, settings in (("name_word", "name_norm_clean", c.name_word), ("address_word", "addr_norm_clean", c.address_word)):
            if settings.enabled:
                found = retrieval.tfidf_search(s1, tfidf(column), column, settings.k)
                channels.append(retrieval.channel(found, f"retrieved_{name}", {"score": f"{name}_score", "rank": f"{name}_rank"}))
        if c.rare_token.enabled:
            found = retrieval.token_search(s1, tokens("name_norm_clean", c.rare_token.most_df), "name_norm_clean", c.rare_token.rarest)
            channels.append(retrieval.channel(retrieval.rare_evidence(found), "retrieved_rare"))
        if c.numeric.enabled:
            found = retrieval.token_search(s1, tokens("addr_numeric_tokens", c.numeric.most_df), "addr_numeric_tokens", None)
            channels.append(retrieval.channel(retrieval.numeric_evidence(found), "retrieved_numeric"))
        return retrieval.union_evidence(channels)

    def rank_and_prune(self, union: DataFrame, most: int | None = None) -> DataFrame:
        return retrieval.rank_and_prune(union, most or self.config.budgets[-1])


class Stages:
    """Stage outputs in a folder, each with a manifest of what made it; a stage whose manifest matches is read, not run."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, name: str) -> str | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.json(str(path)).collect()
        return rows[0]["fingerprint"] if rows else None

    def run(self, name: str, inputs: dict, make) -> DataFrame:
        """The stage's table; ``inputs`` (settings, input fingerprints) decide whether it is current."""
        mark = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()
        path = f"{self.root}/{name}/{mark[:16]}"  # of its own, so what a crash leaves behind is current for no setting and earlier data stays whole
        if self._manifest(name) != mark:
            make().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(name, mark)], "stage string, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}.manifest")
        return self.spark.read.parquet(path)

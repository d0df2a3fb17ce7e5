"""Tables of a directory, and the software-delivery records that are read from them.

The landed tables have no forge data, so each logical table is one projection of them, kept here alone: replacing a
property by a read of real records changes nothing else. Everything is a lazy plan; nothing is cached or collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.sources.advisories import CATALOGUE
from millrace.sources.fixtures import table


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # facts from the event stream

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def now(self) -> Column:
        """The reference time of event facts: their latest, as a scalar subquery."""
        return self.table("events").select(F.max("ts")).scalar()

    @cached_property
    def scans(self) -> DataFrame:
        health = clamp(F.floor(F.col("value") + 0.5), 0, 100).cast("int")
        part = lambda m, less: clamp(health + F.col("k") % m - less, 0, 100).cast("int")
        return self.events.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.concat(F.lit("repo"), F.col("event_id") % 20).alias("repo"),
            health.alias("health"),
            part(11, 5).alias("security"),
            part(7, 3).alias("quality"),
            part(13, 6).alias("performance"),
            (F.col("event_type") == "error").cast("int").alias("critical"),
            (F.col("k") % 3).alias("high"),
            (F.col("k") % 5).alias("medium"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("event_type").alias("feature"),
            F.greatest(F.lit(1), F.col("k")).cast("long").alias("units"),
            F.when(F.col("user_id") % 2 == 0, "free").otherwise("pro").alias("plan"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("repo"), F.col("user_id") % 10).alias("repo"),
            F.concat(F.lit("flow"), F.col("k") % 8).alias("name"),
            F.when(F.col("event_type") == "error", "failure").when(F.col("event_type").isin("purchase", "view"), "success").alias("conclusion"),
            F.when(F.col("event_type") == "signup", "workflow_dispatch").otherwise("push").alias("event"),
            F.when(F.col("user_id") % 3 == 0, "dev").otherwise("main").alias("branch"),
            F.col("ts").alias("started_at"),
            F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value) as decimal(18, 6)))").alias("updated_at"),
        )

    @cached_property
    def user_events(self) -> DataFrame:
        kinds = {"signup": "Create", "purchase": "PullRequest", "click": "Push", "view": "Watch", "error": "Issues"}
        names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        return self.events.select(
            F.col("event_id").alias("id"),
            "user_id",
            names[F.col("event_type")].alias("type"),
            F.concat(F.lit("repo"), F.col("event_id") % 20).alias("repo"),
            (F.col("k") % 5).alias("commits_n"),
            F.col("ts").alias("created_at"),
        )

    # facts from orders

    @cached_property
    def nations(self) -> DataFrame:
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        name = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"))
        return n.select(F.col("n_nationkey").alias("nation"), F.lower("r_name").alias("owner"), name.alias("repo"))

    @cached_property
    def landed(self) -> DataFrame:
        """``(repo, file, content)``: manifests of the repositories. A line item names a package of the catalogue by its part,
        the latest part gives the version; a repository is its supplier's nation and uses some two in five packages."""
        nation = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
        lines = self.table("lineitem").select("l_suppkey", "l_partkey").join(nation, "l_suppkey")
        used = lines.groupBy("nation", (F.col("l_partkey") % len(CATALOGUE)).alias("k")).agg(F.max("l_partkey").alias("p"))
        version = F.concat_ws(".", *[(F.col("p") % n).cast("string") for n in (9, 31, 13)])
        named = used.where((F.col("k") * F.col("k") + 3 * F.col("nation")) % 5 < 2).join(F.broadcast(table(self.spark, "catalogue")), "k").join(F.broadcast(self.nations), "nation")
        by = named.join(F.broadcast(table(self.spark, "forms")), "file").select("repo", "file", "head", "between", "foot", "lib", F.concat("front", "lib", "middle", version, "back").alias("part"))
        whole = by.groupBy("repo", "file", "head", "between", "foot").agg(F.sort_array(F.collect_list(F.struct("lib", "part"))).alias("parts"))
        return whole.select("repo", "file", F.expr("concat(head, array_join(parts.part, between), foot)").alias("content"))

    @cached_property
    def buyers(self) -> DataFrame:
        """Customers with their repository. Nations are a fixed, small table."""
        return self.table("customer").join(F.broadcast(self.nations), F.col("c_nationkey") == F.col("nation"))

    @cached_property
    def orders(self) -> DataFrame:
        buyers = self.buyers.select("c_custkey", "c_name", "nation", "owner", "repo")
        return self.table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def pulls(self) -> DataFrame:
        # reviewers are counted by their rank within a pull: the sort is the join's own, and no table of pairs is held; the
        # greatest rank is taken as a struct, which Spark adds up along that sort instead of in a table of all pulls of a task
        by = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey").asc_nulls_last())
        lines = self.table("lineitem").where("l_orderkey is not null").select(
            "l_orderkey", "l_quantity", "l_linenumber", "l_shipdate", F.when(F.col("l_suppkey").isNotNull(), F.dense_rank().over(by)).alias("nth")
        )
        met = self.table("orders").select("o_orderkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        work = met.groupBy("o_orderkey").agg(
            F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long").alias("additions"),
            F.coalesce(F.sum("l_linenumber"), F.lit(0)).cast("long").alias("deletions"),
            F.count("l_orderkey").alias("changed_files"),
            F.min(F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))).alias("done_at"),
            F.coalesce(F.max(F.struct("nth"))["nth"], F.lit(0)).cast("long").alias("n_reviewers"),
        )
        prefix = F.element_at(F.array(*map(F.lit, ["feat: ", "fix(core): ", "docs: ", "hotfix ", "revert: ", "chore: ", "feat!: "])), (F.col("o_orderkey") % 7 + 1).cast("int"))
        return self.orders.join(work, "o_orderkey").select(
            "repo",
            F.col("o_orderkey").alias("number"),
            F.concat(prefix, F.lit("change "), F.col("o_orderkey")).alias("title"),
            F.col("c_name").alias("author"),
            (F.col("o_custkey") % 12).alias("author_repos"),
            F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
            (F.col("o_orderkey") % 11 == 0).alias("draft"),
            F.col("o_orderpriority").alias("label"),
            "additions",
            "deletions",
            "changed_files",
            "n_reviewers",
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", F.col("done_at")).alias("merged_at"),
            F.when(F.col("o_orderstatus") != "O", F.col("done_at")).alias("closed_at"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        lines = self.table("lineitem").join(self.orders.select("o_orderkey", "repo"), F.col("l_orderkey") == F.col("o_orderkey"))
        suppliers = self.table("supplier").select("s_suppkey", "s_name")
        return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "repo", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sha"), F.col("l_orderkey").alias("number"), F.col("s_name").alias("author"), F.col("l_shipdate").alias("authored_at")
        )

    @cached_property
    def commit_now(self) -> Column:
        """The reference time of order facts."""
        return self.table("lineitem").select(F.max("l_shipdate")).scalar()

    @cached_property
    def weeks(self) -> DataFrame:
        """``(repo, week, total)``: commits of the last 52 weeks, 0 the oldest; weeks without any are there."""
        ago = F.floor(F.datediff(self.commit_now, "authored_at") / 7).cast("int")
        some = self.commits.select("repo", ago.alias("ago")).where("ago < 52").groupBy("repo", "ago").count()
        every = self.nations.select("repo", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("ago"))
        dense = every.join(some, ["repo", "ago"], "left")
        return dense.select("repo", (51 - F.col("ago")).alias("week"), F.coalesce("count", F.lit(0)).alias("total"))

    @cached_property
    def contributors(self) -> DataFrame:
        return self.orders.groupBy("repo", F.col("c_name").alias("login")).agg(F.count("*").alias("contributions"))

    @cached_property
    def languages(self) -> DataFrame:
        return self.table("documents").groupBy(F.col("source").alias("repo"), "lang").agg(F.sum("n_chars").cast("long").alias("bytes"))

    @cached_property
    def files(self) -> DataFrame:
        path = F.concat(F.lit("src/"), F.col("doc_id"), F.lit("."), F.col("lang"))
        return self.table("documents").select(F.col("source").alias("repo"), path.alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content"))

    @cached_property
    def repos(self) -> DataFrame:
        by = self.orders.groupBy("nation").agg(
            F.count("*").alias("stars"),
            F.count_if(F.col("o_orderstatus") == "O").alias("open_issues"),
            F.count_if(F.col("o_orderstatus") == "F").alias("closed_issues"),
            F.min("o_orderdate").alias("created_at"),
            F.max("o_orderdate").alias("pushed_at"),
            F.count_distinct("o_custkey").alias("contributors"),
        )
        forks = self.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("forks"))
        segments = self.table("customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").count()
        language = segments.groupBy("nation").agg(F.min_by("c_mktsegment", F.struct(-F.col("count"), "c_mktsegment")).alias("language"))
        watchers = self.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("watchers"))
        joined = self.nations.join(by, "nation", "left").join(forks, "nation", "left").join(watchers, "nation", "left").join(language, "nation", "left")
        n = F.col("nation")
        zero = ["stars", "forks", "watchers", "open_issues", "closed_issues", "contributors"]
        return joined.fillna(0, zero).select(
            "nation",
            "repo",
            "owner",
            *zero,
            "created_at",
            "pushed_at",
            "language",
            (n % 6 == 5).alias("private"),
            (n % 7 == 6).alias("archived"),
            (n % 5 == 4).alias("fork"),
            (n % 2 == 0).alias("has_wiki"),
            (n % 3 == 0).alias("has_pages"),
            (n % 5 == 0).alias("has_discussions"),
            (n % 4 == 0).alias("has_projects"),
            F.when(n % 3 != 0, "mit").alias("license"),
            (n % 4 == 1).alias("code_of_conduct"),
        )

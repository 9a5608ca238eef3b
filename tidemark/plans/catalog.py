"""Queries of the selection and accounting operators over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.backends import GridRequest, Stub, predicted
from tidemark.functions import columns as C
from tidemark.operators import cost, lineage, metrics, registry, scope, selection
from tidemark.operators.order import places
from tidemark.plans import sql
from tidemark.sources import files, images
from tidemark.sources.shared import new_place
from tidemark.sources.tables import arrivals, matrix, samples, table
from tidemark.streaming import arrivals as stream
from tidemark.streaming import keys

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

SEED, REPLAY, BATCH, EPOCHS, DEVICES = 42, 500, 16, 100, 2
FOLDED = ("SS", "ß", "ẞ", "ss", "Σας", "σασ", "İ", "i̇", "I", "ﬁ", "FI", "Ǆ")
EVENT_TYPES = ("click", "purchase", "refund", "signup", "view")


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _train(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("split = 'train'")


def _scope(spark: SparkSession, d: str, task: int, rule: str = "all_seen") -> DataFrame:
    """The scope of one task, its groups named by arrival number."""
    everyone = samples(spark, d)
    names = [f"src{i}" for i in range(task + 1)]
    now = names[-1:]
    return scope.resolve(everyone, now, names if rule == "all_seen" else now, names, names)


@query
def registry_counts(spark, d):
    return registry.group_index(samples(spark, d)).withColumnRenamed("group", "grp")


@query
def group_members(spark, d):
    return registry.group_members(samples(spark, d)).select(F.col("group").alias("grp"), "split", F.array_join("ids", ",").alias("ids"))


@query
def relative_path(spark, d):
    return samples(spark, d).select("sample_id", C.relative_path(F.col("image_path"), F.concat(F.lit("/data/"), "group")).alias("p"))


@query
def label_path(spark, d):
    return samples(spark, d).select("sample_id", C.label_path(F.col("image_path")).alias("p"))


@query
def duplicate_ids(spark, d):
    return registry.duplicate_ids(table(spark, d, "events").select(F.col("user_id").alias("sample_id")))


@query
def dup_owner_check(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(C.owner_key(F.col("text")), 256).alias("path"))
    return registry.shared_owners(docs, "path", "doc_id").select(F.col("owner_key").alias("k"), "n", "first_id")


@query
def label_schema_check(spark, d):
    names = samples(spark, d).groupBy("group").agg(F.sort_array(F.collect_set("lang")).alias("names"))
    return registry.schema_matches(names.join(arrivals(spark, d), "group").select("group", F.col("idx").alias("place"), "names")).withColumnRenamed("group", "grp")


@query
def names_normalize(spark, d):
    ranked = samples(spark, d).select("group", "lang").distinct()
    number = F.row_number().over(Window.partitionBy("group").orderBy("lang")) - 1
    maps = ranked.withColumn("i", number).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("i", "lang"))).alias("m"))
    return maps.select(F.col("group").alias("grp"), F.array_join(C.names_in_order(F.col("m")), ",").alias("names"))


@query
def scope_counts(spark, d):
    return scope.counts(samples(spark, d), arrivals(spark, d))


@query
def scope_counts_current(spark, d):
    return scope.counts(samples(spark, d), arrivals(spark, d), "current")


@query
def scope_roles(spark, d):
    return _scope(spark, d, 10).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query
def scope_history_except(spark, d):
    return _scope(spark, d, 10).where("role = 'history'").select("sample_id")


@query
def scope_test_by_group(spark, d):
    return _scope(spark, d, 5).where("role = 'test'").select(F.col("group").alias("grp"), "sample_id")


@query
def split_disjoint(spark, d):
    """Users that stand in more than one of three roles."""
    role = F.when(F.col("event_type") == "click", "candidate").when(F.col("event_type") == "purchase", "validation").when(F.col("event_type") == "refund", "test")
    return scope.overlaps(table(spark, d, "events").select(role.alias("role"), F.col("user_id").alias("sample_id")).where("role is not null"))


@query
def current_in_candidate(spark, d):
    found = _scope(spark, d, 10)
    role = lambda r: found.where(F.col("role") == r).select("sample_id")
    return role("current").join(role("candidate"), "sample_id", "left_semi")


@query
def missing_ids_anti(spark, d):
    return registry.unknown_ids(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query
def labeled_semi(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query
def select_full(spark, d):
    seen = scope.sees(arrivals(spark, d), "all_seen")
    return _train(spark, d).join(seen, "group").select("task", "sample_id")


@query
def select_random_replay(spark, d):
    picked = selection.policy("random_replay", {"replay_size": REPLAY, "draw": "hash"}).select(_scope(spark, d, 19), SEED + 19)
    return picked.select("sample_id", "role")


@query
def select_current_only(spark, d):
    picked = selection.policy("full").select(_scope(spark, d, 10, "current"), SEED + 10)
    return selection.epoch_policy("static").plan(picked, 0, SEED + 10).select("sample_id")


@query
def replay_per_task(spark, d):
    return selection.replay_per_task(_train(spark, d).select("group", "sample_id"), arrivals(spark, d), 50, SEED)


@query
def selection_summary(spark, d):
    counts = scope.counts(samples(spark, d), arrivals(spark, d))
    full = counts.select("task", F.lit("full").alias("policy"), F.col("candidate_count").alias("candidate"))
    replay = counts.select("task", F.lit("random_replay").alias("policy"), F.col("candidate_count").alias("candidate"), F.col("current_count").alias("cur"), F.least(F.lit(50), "history_count").cast("long").alias("replay"))
    return full.unionByName(replay, allowMissingColumns=True).select("task", "policy", "cur", "replay", "candidate")


@query
def manifest_bind(spark, d):
    chosen = samples(spark, d).where("split = 'val'").select("sample_id", "group")
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("sample_id")))
    ids = chosen.select("sample_id", place.cast("long").alias("pos"))
    return registry.bind(ids, samples(spark, d), "image_path", "n_chars")


@query
def predict_zip(spark, d):
    """Positional join: ids and predictions of a request, by place."""
    asked = places(samples(spark, d).where("split = 'test'").select("group", "sample_id", "n_chars"), "sample_id", ("group",))
    answers = asked.select(F.col("group").alias("_group"), F.col("_place").alias("_at"), (F.col("n_chars") * 2).alias("prediction"))
    zipped = asked.join(answers, F.col("group").eqNullSafe(F.col("_group")) & (F.col("_place") == F.col("_at")))
    return zipped.select(F.col("_place").alias("pos"), "sample_id", "prediction")


@query
def override_left_join(spark, d):
    events = table(spark, d, "events")
    overrides = events.where("event_type = 'refund'").groupBy("user_id").agg(F.max("event_id").alias("replay_size"))
    return lineage.overridden(events.select("user_id").distinct(), overrides, "user_id", "replay_size", REPLAY)


@query
def eval_cross(spark, d):
    tests = samples(spark, d).where("split = 'test'").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    checkpoints = spark.createDataFrame([("last",), ("best",)], "checkpoint string")
    return metrics.evaluation_grid(checkpoints, tests).withColumnRenamed("group", "grp")


@query
def eval_seconds(spark, d):
    events = table(spark, d, "events")
    task = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int").alias("task")
    rows = events.select(task, F.when(F.col("event_type") != "click", F.col("event_id") % 7 * 0.5).alias("evaluation_seconds"))
    return metrics.evaluation_seconds(rows)


@query
def metric_matrix(spark, d):
    return matrix(spark, d).withColumnRenamed("group", "grp")


@query
def metric_scores(spark, d):
    """Scores of one of two checkpoints, by task and group, from a log of both."""
    events = table(spark, d, "events")
    task = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int").alias("task")
    log = events.groupBy(task, F.when(F.col("event_id") % 2 == 0, "last").otherwise("best").alias("checkpoint"), F.col("event_type").alias("group")).agg(F.round(F.avg("value"), 6).alias("map50"))
    return metrics.scores(log, "best", "map50").withColumnRenamed("group", "grp")


@query
def metric_pivot(spark, d):
    return metrics.pivoted(matrix(spark, d), list(EVENT_TYPES), "{}__map50_95")


@query
def seen_mean(spark, d):
    return metrics.seen_mean(matrix(spark, d)).select("task", F.round("seen_mean", 5).alias("seen_mean"), "n")


@query
def final_forgetting(spark, d):
    return metrics.forgetting(matrix(spark, d)).select(F.col("group").alias("grp"), F.round("forgetting", 6).alias("forgetting"))


@query
def mean_forgetting(spark, d):
    return metrics.mean_forgetting(matrix(spark, d)).select(F.round("final_mean_forgetting", 5).alias("final_mean_forgetting"))


@query
def running_forgetting(spark, d):
    return metrics.running_forgetting(matrix(spark, d)).select("task", F.col("group").alias("grp"), F.round("forgetting", 6).alias("forgetting"))


@query
def cost_by_task(spark, d):
    counts = scope.counts(samples(spark, d), arrivals(spark, d)).select(F.col("task").alias("idx"), F.col("candidate_count").alias("n"))
    timed = cost.estimate(counts, BATCH, EPOCHS).withColumn("selection_seconds", F.col("idx") * 0.5).withColumn("training_seconds", F.col("n") * 0.25).withColumn("devices", F.lit(DEVICES))
    return cost.account(timed).select("idx", "optimizer_steps", "images_read", F.round("method_seconds", 6).alias("method_seconds"), F.round("gpu_hours", 6).alias("gpu_hours"))


@query
def device_counts(spark, d):
    kind = F.col("event_id") % 4
    named = F.when(kind == 0, "cpu").when(kind == 1, "CPU").otherwise(F.col("user_id").cast("string"))
    listed = F.when(kind == 3, F.slice(F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.lit(1), (F.col("user_id") % 4).cast("int")))
    return table(spark, d, "events").select("event_id", C.device_count(named, listed).cast("long").alias("n"))


@query
def lineage_parent(spark, d):
    return lineage.with_parent(table(spark, d, "conversations").select("conv_id", "turn"), "turn", "turn", "conv_id")


@query
def stop_after_failure(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("grp"), "ts", "event_id", (F.col("event_id") % 97 == 96).alias("failed"))
    tried = lineage.before_failure(events, ["ts", "event_id"], "failed", "grp")
    return tried.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query
def status_latest(spark, d):
    return lineage.latest(table(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "event_type").withColumnRenamed("event_type", "status")


@query
def suffix_filter(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^?#]*", 0)
    pages = table(spark, d, "pages").select(C.suffix(path).alias("suffix")).where(F.col("suffix").isin("html", "com", *C.IMAGE_SUFFIXES) | (F.col("suffix") == ""))
    return pages.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


@query
def sanitize_names(spark, d):
    return table(spark, d, "pages").select("url", C.sanitize(F.col("url"), 24).alias("s"))


@query
def number_parse(spark, d):
    return table(spark, d, "events").select("event_id", C.number(F.get_json_object("props", "$.k")).alias("k"))


@query
def number_cells(spark, d):
    """Numbers as people write them, and what only looks like one."""
    n = F.col("event_id").cast("string")
    kinds = [n, F.concat(F.lit(" "), n, F.lit(".5 ")), F.concat(F.lit("x"), n), F.concat(n, F.lit("_000")), F.concat(n, F.lit("d")), F.concat(F.lit("-.5e"), (F.col("event_id") % 9).cast("string")), F.lit(""), F.concat(n, F.lit("e"))]
    cells = table(spark, d, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % 8 + 1).cast("int")).alias("cell"))
    return cells.select("event_id", "cell", C.number(F.col("cell")).alias("v"))


@query
def arrival_index(spark, d):
    rows = scope.numbered(arrivals(spark, d).select("group", F.col("idx").alias("ord")), "ord")
    return rows.select(F.col("group").alias("grp"), "idx", (F.col("idx") + SEED).alias("seed"), F.concat_ws("__", C.task_name(F.col("idx")), C.sanitize(F.col("group"))).alias("task_name"))


@query
def ragged_union(spark, d):
    counts = scope.counts(samples(spark, d), arrivals(spark, d))
    a = counts.where("task < 10").select("task", F.col("current_count").alias("current"))
    b = counts.where("task >= 10").select("task", F.col("current_count").alias("current"), F.col("history_count").alias("replay"))
    return a.unionByName(b, allowMissingColumns=True)


@query
def config_layers(spark, d):
    """Settings of users, event by event: the last one counts, also if it is null."""
    key = F.concat_ws(".", "event_type", F.col("user_id").cast("string"))
    value = F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))
    return lineage.layered(table(spark, d, "events").select(F.col("event_id").alias("layer"), key.alias("k"), value.alias("v")))


@query
def scope_disjoint(spark, d):
    return scope.overlaps(_scope(spark, d, 19)).agg(F.count(F.lit(1)).alias("n"))


# what is written and read again


@query
def manifest_paths(spark, d):
    """A manifest of untidy relative paths, some twice, and the images that it names."""
    place = new_place(spark, "manifest")
    line = F.concat(F.lit("  ../"), "group", F.lit("/./x/../images//"), F.col("doc_id").cast("string"), F.lit(".JPG "))
    rows = samples(spark, d).select(F.explode(F.array(line, F.lit("   "), line)).alias("value"))
    rows.write.text(f"{place}/lists/all.txt")
    found = images.split_files(spark, f"{place.removeprefix('file://')}/lists", ("all.txt",))
    return found.select(F.regexp_extract("path", "([^/]+/images/[^/]+)$", 1).alias("path"))


@query
def ordered_lines(spark, d):
    """Ids written line by line, with their places in the folder's parts."""
    place = new_place(spark, "lines")
    files.put_lines(samples(spark, d).select("sample_id"), place, "sample_id")
    parts = spark.read.text(place, wholetext=True).select(F.col("_metadata.file_name").alias("part"), F.split(F.regexp_replace("value", "\\n$", ""), "\n").alias("lines"))
    sizes = parts.select("part", F.size("lines").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(sizes, "part").select(F.posexplode("lines").alias("at", "sample_id"), "first").select((F.col("first") + F.col("at")).alias("pos"), "sample_id")


@query
def history_csv(spark, d):
    """Measurements as text with blanks around names: columns of numbers come back as numbers."""
    place = new_place(spark, "history")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias(" epoch "), F.format_string(" %s ", F.col("event_id") / 4).alias("loss"), F.col("event_type").alias(" note"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return files.get_history(spark, place)


@query
def ragged_csv(spark, d):
    """One row per task in files whose rows differ in their keys; lacking cells are empty."""
    path, text = new_place(spark, "ragged"), lambda c: F.col(c).cast("string")
    counts = scope.counts(samples(spark, d), arrivals(spark, d))
    all_cells = F.create_map(F.lit("task"), text("task"), F.lit("current"), text("current_count"), F.lit("replay"), F.nullif(text("history_count"), F.lit("0")))
    files.put_ragged(counts.select("task", F.map_filter(all_cells, lambda k, v: v.isNotNull()).alias("cells")), path, "task")
    return spark.read.option("header", True).schema("task int, current bigint, replay bigint").csv(path)


@query
def scope_sink(spark, d):
    """A task's scope, written by role and group and read again."""
    place = new_place(spark, "scope")
    _scope(spark, d, 12).write.partitionBy("role", "group").parquet(place)
    kept = spark.read.schema("sample_id string, role string, group string").parquet(place)
    return kept.groupBy("role", F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.max("sample_id").alias("hi"))


@query
def selection_sink(spark, d):
    """The selected ids of a task by role, and the union of the roles."""
    place = new_place(spark, "selected")
    selection.policy("random_replay", {"replay_size": REPLAY, "draw": "hash"}).select(_scope(spark, d, 14), SEED + 14).write.partitionBy("role").parquet(place)
    kept = spark.read.schema("sample_id string, role string").parquet(place)
    return kept.groupBy("sample_id").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("n"))


@query
def arrival_stream(spark, d):
    """Samples as a stream of files: the scope counts of all tasks after the last batch."""
    place = new_place(spark, "stream")
    rows = samples(spark, d).join(arrivals(spark, d), "group").select("sample_id", "group", "split", "idx")
    rows.repartitionByRange(4, "idx").write.parquet(f"{place}/in")
    seen = []
    query = stream.follow(stream.source(spark, f"{place}/in", 2), f"{place}/registry", f"{place}/checkpoint", lambda counts, number: seen.append(counts))
    query.awaitTermination()
    return seen[-1]


@query
def select_numpy_replay(spark, d):
    """The default draw: what numpy's generator takes from the sorted history."""
    return selection.policy("random_replay", {"replay_size": 20}).select(_scope(spark, d, 14), SEED + 14).select("sample_id", "role")


@query
def member_chunks(spark, d):
    chunks = registry.member_chunks(samples(spark, d), 7)
    return chunks.select(F.col("group").alias("grp"), "split", "chunk", "first", F.array_join("ids", ",").alias("ids"), "digest")


@query
def path_faults(spark, d):
    """Paths that leave the root, name no images folder, or are lacking."""
    kind, name = F.col("doc_id") % 7, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))
    path = F.when(kind == 0, F.concat(F.lit("/other/images/"), name)).when(kind == 1, F.concat(F.lit("/data/pictures/"), name)).when(kind > 2, F.concat(F.lit("/data/Images/"), name))
    rows = samples(spark, d).select(F.col("doc_id").alias("sample_id"), "doc_id").withColumn("image_path", path)
    return registry.path_faults(rows, "/data").withColumnRenamed("sample_id", "doc_id")


@query
def empty_splits(spark, d):
    """Splits without samples, where each language of a source is a group."""
    rows = samples(spark, d).select(F.concat_ws("/", "group", "lang").alias("group"), "split")
    return registry.empty_splits(rows, rows.select("group").distinct()).withColumnRenamed("group", "grp")


@query
def prediction_table(spark, d):
    """Answers of a model that runs in the tasks, by place; the model tells a path backwards."""
    asked = places(samples(spark, d).where("split = 'test'").select("sample_id", "image_path"), "sample_id")
    return predicted(asked.withColumnRenamed("_place", "pos").repartition(4, "sample_id"), lambda: lambda paths: [p[::-1] for p in paths], 7)


@query
def evaluation_table(spark, d):
    """Every checkpoint with every group by the backend that answers without a model."""
    tests = samples(spark, d).where("split = 'test'").select("group", F.col("sample_id").alias("pos"), "sample_id", "image_path")
    groups = tuple(r["group"] for r in arrivals(spark, d).select("group").orderBy("idx").collect())  # as a configuration names them
    asked = GridRequest({"backend": {"params": {"batch": BATCH}}}, tests, groups, ("a", "b"), {"last": "l", "best": "b"}, "")
    return Stub(spark).evaluate_grid(asked).select("checkpoint", F.col("group").alias("grp"), F.round("map50_95", 9).alias("map50_95"), "sample_count", F.round("evaluation_seconds", 9).alias("evaluation_seconds"))


def _claiming(spark: SparkSession, d: str) -> DataFrame:
    """Samples as a careless arrival names them: by language and length, with a path by the text whatever its case."""
    idx = F.substring("source", 4, 10).cast("int").alias("idx")
    rows = table(spark, d, "documents").where("source is not null").select("*", F.col("source").alias("group"), idx)
    text = C.casefold(F.coalesce("text", F.lit("")))
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/data/IMAGES/Straße-").otherwise("/data/images/STRASSE-"), F.md5(text), F.lit(".jpg"))
    name = F.concat_ws("/", "lang", F.col("n_chars").cast("string"))
    return rows.select(C.sample_id(F.col("group"), name).alias("sample_id"), "group", F.lit("train").alias("split"), "idx", path.alias("image_path"))


def _checked_stream(spark: SparkSession, d: str) -> str:
    """The registry after five groups a batch have arrived, each checked against all before.

    The texts are read once; their claims, a few short columns, are kept by batch.
    The claims of a batch land in as many files as they take, and the stream goes on
    from where it stood with all of them.
    """
    place = new_place(spark, "checked")
    _claiming(spark, d).withColumn("batch", F.floor(F.col("idx") / 5).cast("int")).write.partitionBy("batch").parquet(f"{place}/rows")
    rows = spark.read.schema(stream.CHECKED + ", batch int").parquet(f"{place}/rows")
    last = rows.agg(F.max("batch")).first()[0] or 0
    own = keys.session(spark)
    for batch in range(last + 1):
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{place}/in")
        source = stream.source(own, f"{place}/in", None, stream.CHECKED)
        stream.follow_checked(source, f"{place}/registry", f"{place}/checkpoint", lambda counts, number: None).awaitTermination()
    return f"{place}/registry"


@query
def stream_clashes(spark, d):
    """Ids and paths that samples of a stream claim more than once, over all batches."""
    return stream.clash_table(spark, _checked_stream(spark, d)).withColumnRenamed("key", "k")


@query
def stream_accepted(spark, d):
    """Samples that a checked stream takes, and the batch in which it takes them."""
    return spark.read.schema(stream.CHECKED + ", batch int").parquet(_checked_stream(spark, d)).select("sample_id", "batch")


@query
def claimed_keys(spark, d):
    """The same clashes of the table as a whole."""
    return keys.clashes(keys.claims(_claiming(spark, d), "idx")).withColumnRenamed("key", "k")


@query
def owner_fold(spark, d):
    """Owners of paths whose names differ in ways that only full case folding knows."""
    letter = F.element_at(F.array(*[F.lit(x) for x in FOLDED]), (F.col("event_id") % len(FOLDED) + 1).cast("int"))
    path = F.concat(F.lit("/Images/"), F.col("user_id").cast("string"), F.lit("/"), letter, F.lit(".JPG"))
    return registry.shared_owners(table(spark, d, "events").select("event_id", path.alias("path")), "path", "event_id").select(F.col("owner_key").alias("k"), "n", "first_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLES.items() if name in _QUERIES}

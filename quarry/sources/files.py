"""Sources: program files, knowledge tables, JSON documents and run folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graphs, lookups
from quarry.sources import splits

#: Folders that are never scanned.
PRUNED = ("node_modules", ".git", "build", "dist", "out", "hvigor")
#: Columns of the knowledge table.
KEY, ACTION, DETAIL, PERMISSIONS, DATA, DATA_DETAIL = "相关API", "敏感行为", "行为子项", "相关权限", "敏感数据项", "敏感数据子项"


def read_texts(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path, text) of all files below ``root`` whose names end with a suffix, without pruned folders; in no order."""
    df = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if pruned:
        df = df.where(~F.col("path").rlike("/(" + "|".join(p.replace(".", r"\.") for p in pruned) + ")/"))
    if suffixes:
        df = df.where(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return df


def app_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of an app's code: main code, else the entry module's, else what is left of a build."""
    p = F.col("path")
    main = F.contains(p, F.lit("/src/main/ets/")) & ~F.contains(p, F.lit("/src/ohosTest/"))
    built = F.contains(p, F.lit("/build/"))
    tier = F.when(main & ~built, 1).when(F.contains(p, F.lit("/entry/src/main/ets/")) & ~built, 2).when(built & F.contains(p, F.lit("/src/main/ets/")), 3)
    keep = tuple(x for x in PRUNED if x != "build")
    return lookups.first_tier(read_texts(spark, root, (".ets", ".ts"), keep), tier)


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV tables below ``path`` that have the API column: file, row, key and trimmed cells; files without it give nothing."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    head = F.regexp_replace(F.split(F.col("value"), "\r?\n")[0], "^﻿", "")
    named = raw.select(F.col("_metadata.file_path").alias("file"), head.alias("head"), F.array_contains(F.transform(F.split(head, ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))), KEY).alias("own")).where("own")
    # files with the same heading are read together: a heading each, not a plan for each file
    heads: dict[str, list[str]] = {}
    for r in named.select("head", "file").collect():  # names of knowledge files
        heads.setdefault(r.head, []).append(r.file)
    out = None
    for files in heads.values():
        df = spark.read.csv(sorted(files), header=True, multiLine=True, escape='"', mode="PERMISSIVE")
        placed = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)], F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
        names = {c.lstrip("\ufeff").strip(): f"_c{i}" for i, c in enumerate(df.columns)}
        cell = lambda c: T.trim_all(F.coalesce(F.col(names[c]), F.lit(""))) if c in names else F.lit("")  # noqa: B023, E731
        one = placed.select("file", "row", T.normalize_api_key(cell(KEY)).alias("key"), cell(ACTION).alias("action"), cell(DETAIL).alias("detail"), cell(PERMISSIONS).alias("permissions"), cell(DATA).alias("data"), cell(DATA_DETAIL).alias("data_detail"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "file string, row long, key string, action string, detail string, permissions string, data string, data_detail string")
    return out.where(F.col("key").startswith("@ohos.") | F.col("key").startswith("@kit."))


def api_descriptions(knowledge: DataFrame) -> DataFrame:
    """(key, description): the first row of each key that says something."""
    said = T.compose_description(F.col("action"), F.col("detail"), F.col("permissions"), F.col("data"), F.col("data_detail"))
    rows = knowledge.withColumn("description", said).where("description <> ''")
    return lookups.first_wins(rows, ["key"], "file", "row").select("key", "description")


def api_permissions(knowledge: DataFrame) -> DataFrame:
    """(key, permissions): the sorted union over all rows of a key."""
    tokens = knowledge.select("key", F.explode(T.extract_tokens(F.col("permissions"))).alias("p"))
    return tokens.groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("permissions"))


def override_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(key, description) of a CSV (api, description): the last row counts. A missing file gives none."""
    try:
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except Exception as e:  # Spark's name for it
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, description string")
    rows = df.select(T.normalize_api_key(F.col("api")).alias("key"), T.trim_all(F.col("description")).alias("description"), F.monotonically_increasing_id().alias("row"))
    return lookups.last_wins(rows.where("key <> '' and description <> ''"), ["key"], "row").drop("row")


def sdk_modules(files: DataFrame) -> DataFrame:
    """(module, path): declaration files by module name; .d.ts before .d.ets, then by path."""
    m = F.regexp_extract("path", r"/(@(?:ohos|kit)\.[^/]+?)\.d\.(?:ts|ets)$", 1)
    return lookups.first_wins(files.select(m.alias("module"), "path", F.col("path").endswith(".d.ets").alias("late")).where("module <> ''"), ["module"], "late", "path").select("module", "path")


def kit_exports(modules: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(kit, exported, module, kind, imported): what each kit's file passes on, through its own imports or straight from a module; the last of equal names counts.

    ``modules`` (module, path) say which file a kit is. An import that is passed on keeps its kind; what comes straight from a module is its default
    export or has a name.
    """
    kits = modules.where(F.col("module").startswith("@kit.")).select(F.col("module").alias("kit"), "path")
    own = exports.join(kits, "path")
    kind = F.when(F.col("local") == "default", "default").otherwise("named")
    straight = own.where("module is not null").select("kit", "exported", "pos", "module", kind.alias("kind"), F.col("local").alias("imported"))
    last = lookups.last_wins(imports, ["path", "local"], "import_line").select("path", "local", "module", "kind", "imported")
    bound = own.where("module is null").drop("module").join(last, ["path", "local"]).select("kit", "exported", "pos", "module", "kind", "imported")
    return lookups.last_wins(straight.unionByName(bound), ["kit", "exported"], "pos").drop("pos")


def string_table(spark: SparkSession, *candidates: str) -> DataFrame:
    """(name, value) of the first candidate file that reads and parses; the last of equal names counts."""
    for path in candidates:
        try:
            df = spark.read.schema("string array<struct<name:string,value:string>>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
            if df.where("_corrupt is null and string is not null").isEmpty():
                continue
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        rows = df.select(F.posexplode("string").alias("pos", "x")).select("pos", F.trim("x.name").alias("name"), F.trim("x.value").alias("value"))
        return lookups.last_wins(rows.where("name <> '' and value <> ''"), ["name"], "pos").drop("pos")
    return spark.createDataFrame([], "name string, value string")


#: Where an app keeps its string resources.
STRINGS = ("entry/src/main/resources/base/element/string.json", "AppScope/resources/base/element/string.json")


def app_strings(spark: SparkSession, root: str) -> DataFrame:
    """(name, value) of an app's string resources."""
    return string_table(spark, *(f"{root.rstrip('/')}/{place}" for place in STRINGS))


_NODE = "id long, labels array<string>, properties struct<artifact:string,startLine:int,endLine:int,code:string,name:string,localName:string,fullName:string>"
_EDGE = "type string, startNode long, endNode long"
#: Edge types that are kept.
EDGE_TYPES = ("AST", "INVOKES", "EOG", "DFG", "PDG")


def read_cpg(spark: SparkSession, path: str, files: DataFrame, size: int = splits.RANGE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a code property graph in one JSON document: nodes of the scanned files (path) with labels and a line, edges between them.

    The document is read by a task for every ``size`` bytes, and its records are written once for both.
    """
    own = graphs._cut(splits.json_records(spark, path, size).where(F.col("list").isin("nodes", "edges")))
    n = own.where("list = 'nodes'").select(F.from_json("record", _NODE).alias("n")).select("n.id", "n.labels", F.regexp_replace(F.trim("n.properties.artifact"), "^file:(//)?", "").alias("path"), F.col("n.properties.startLine").alias("line"), F.col("n.properties.endLine").alias("end_line"), F.col("n.properties.code").alias("code"), F.coalesce(F.nullif(F.trim("n.properties.localName"), F.lit("")), F.col("n.properties.name")).alias("name"), F.col("n.properties.fullName").alias("full_name"))
    n = n.where("id is not null and size(labels) > 0 and line >= 1").where(~F.exists("labels", lambda x: x.startswith("Problem")))
    n = n.withColumn("end_line", F.greatest("line", F.coalesce("end_line", "line"))).join(files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")).distinct(), "path", "left_semi")
    e = own.where("list = 'edges'").select(F.from_json("record", _EDGE).alias("e")).select(F.col("e.startNode").alias("src"), F.col("e.endNode").alias("dst"), F.col("e.type").alias("type")).where(F.col("type").isin(*EDGE_TYPES))
    ids = n.select("id").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e.select("src", "dst", "type")


def app_permissions(files: DataFrame) -> DataFrame:
    """(permission): names in code and settings, tests left out."""
    own = files.where(~F.contains(F.col("path"), F.lit("/src/ohosTest/")))
    return own.select(F.explode(T.extract_tokens(F.col("text"))).alias("permission")).distinct()


#: Calls that ask the user, where their permissions stand among the arguments, and how far they reach.
REQUESTS = ((r"(?s)\b(?:[\w$.]+\.)?requestPermissionsFromUser\s*\((.{0,400}?)\)", 1), (r"(?s)\b[\w$]+\.(?:request|requestPermission)\s*\((.{0,300}?)\)", 0))
_DOTTED = r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$"


def runtime_permissions(files: DataFrame) -> DataFrame:
    """(permission): asked of the user at run time: named in the call, else through the constant that it names, looked up in its own file first, then in all."""
    code = files.where(~F.contains(F.col("path"), F.lit("/src/ohosTest/")) & F.col("path").rlike(r"\.(ets|ts|js)$")).select("path", "text")
    asked = None
    for pattern, at in REQUESTS:
        said = code.select("path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("said"))
        one = said.select("path", "said", T.clean_text(F.get(F.split("said", ","), at)).alias("ref"))
        asked = one if asked is None else asked.unionByName(one)
    named = asked.withColumn("own", T.extract_tokens(F.col("said")))
    direct = named.select(F.explode("own").alias("permission"))
    refs = named.where((F.size("own") == 0) & F.col("ref").rlike(_DOTTED)).select("path", "ref").distinct()
    return direct.unionByName(constants(refs, code).select("permission")).distinct()


def constants(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ref, permission): permissions behind the names (path, ref): what is assigned to the name, or else to its last part, in its own file, else in the first that has any.

    A value reaches 400 characters. Every assignment whose value names permissions is found once; names and assignments meet in an equi join on the name.
    """
    pattern = F.lit(r"(?s)(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*[^=\n]{0,160}=)(?=\s*([^=].{0,399}))")
    found = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("left"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("right"))).alias("c"))
    names = F.regexp_extract_all("c.left", F.lit(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"), F.lit(0))
    set_ = found.select("path", F.explode(F.array_distinct(names)).alias("name"), T.extract_tokens(F.col("c.right")).alias("permissions")).where("size(permissions) > 0")
    wanted = refs.select(F.col("path").alias("own"), "ref", F.posexplode(F.array_distinct(F.array("ref", F.element_at(F.split("ref", r"\."), -1)))).alias("rank", "name"))
    met = lookups.pick_one(wanted.join(set_, "name"), ["own", "ref"], F.col("rank"), F.col("own") != F.col("path"), F.col("path"), F.col("permissions"))
    return met.select(F.col("own").alias("path"), "ref", F.explode("permissions").alias("permission"))


def groundtruth(spark: SparkSession, path: str) -> DataFrame:
    """(app, permission) of text files, one app each: tokens of a line, else the line itself if it begins as one does."""
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("app"), "value")
    line = T.trim_all(F.regexp_replace("value", "（[^）]*）", ""))
    tokens = T.extract_tokens(F.col("value"))
    told = F.when(F.size(tokens) > 0, tokens).when(line.startswith("ohos.permission."), F.array(line)).otherwise(F.array().cast("array<string>"))
    return rows.select("app", F.explode(told).alias("permission")).distinct()


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """(path, permission) of all privacy_facts.json files below ``root``."""
    schema = "facts struct<permissionPractices:array<struct<permissionName:string>>>"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "privacy_facts.json").json(root, multiLine=True)
    names = df.select(F.col("_metadata.file_path").alias("path"), F.explode("facts.permissionPractices.permissionName").alias("name"))
    return names.select("path", F.explode(T.extract_tokens(F.col("name"))).alias("permission")).distinct()


#: Where a run's own walk finds predictions, and its narrower pattern of names.
RUN_FACTS, RUN_PERMISSION = r"/(pages/[^/]+/features/[^/]+|app_permissions)/privacy_facts\.json$", r"ohos\.permission\.[A-Z0-9_]+"


def run_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(permission): as ``predictions``, but only of a run's features and of the app, and names in capitals only."""
    schema = "facts struct<permissionPractices:array<struct<permissionName:string>>>"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "privacy_facts.json").json(root, multiLine=True).where(F.col("_metadata.file_path").rlike(RUN_FACTS))
    return df.select(F.explode("facts.permissionPractices.permissionName").alias("name")).select(F.explode(F.regexp_extract_all("name", F.lit(RUN_PERMISSION), F.lit(0))).alias("permission")).distinct()


def run_registry(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, output_dir, mtime) of the registry's entries, the latest first; broken ones left out."""
    df = spark.read.schema("runId string, outputDir string").option("pathGlobFilter", "*.json").json(root, multiLine=True)
    name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    rows = df.select(F.coalesce("runId", name).alias("run_id"), F.col("outputDir").alias("output_dir"), F.col("_metadata.file_modification_time").alias("mtime"), name.alias("name"))
    return rows.where("name <> 'latest' and output_dir is not null").drop("name").orderBy(F.desc("mtime"), "run_id")


def resolve_run(runs: DataFrame, output_dir: str | None = None, run_id: str | None = None) -> str | None:
    """A run's folder: the one given, else that of the run of this id, else that of the latest run (run_id, output_dir, mtime); None without any."""
    if output_dir and output_dir.strip():
        return output_dir.strip()
    known = runs.where(F.col("run_id") == run_id) if run_id else runs
    row = known.orderBy(F.desc("mtime"), F.desc("run_id")).select("output_dir").first()
    return row.output_dir if row else None


def latest_runs(runs: DataFrame, app: str = "app", at: str = "run_ts") -> DataFrame:
    return runs.groupBy(app).agg(F.max(at).alias(at))


_SINK = "`App源码文件路径` string, `调用行号` int, `__apiKey` string"


def sink_records(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(path, file_path, call_line, api_key, valid) of the JSON arrays of sinks at or below ``path``; rows without a file, a line or a key are kept as invalid."""
    df = spark.read.schema(_SINK).option("recursiveFileLookup", True).option("pathGlobFilter", names).json(path, multiLine=True)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    got = df.select(F.col("_metadata.file_path").alias("path"), text(F.col("App源码文件路径")).alias("file_path"), F.col("调用行号").alias("call_line"), text(F.col("__apiKey")).alias("api_key"))
    return got.withColumn("valid", F.col("file_path").isNotNull() & F.col("call_line").isNotNull() & F.col("api_key").isNotNull())


def by_app_and_run(df: DataFrame, root: str) -> DataFrame:
    """``df`` with ``app`` and ``run_ts``: the folders of its files (path) below ``root``."""
    parts, depth = F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/"), len([x for x in root.split("://")[-1].split("/") if x])
    return df.withColumns({"app": F.get(parts, F.lit(depth + 1)), "run_ts": F.get(parts, F.lit(depth + 2))})


def checked(df: DataFrame, needed: list[str], numbers: list[str] = (), kinds: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows fit to show, rows that aren't): ``needed`` columns aren't null or blank, ``numbers`` are 1 or more, ``kinds`` have one of the values named."""
    fit = F.lit(True)
    for c in needed:
        fit = fit & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    for c in numbers:
        fit = fit & F.coalesce(F.col(c) >= 1, F.lit(False))
    for c, values in (kinds or {}).items():
        fit = fit & F.coalesce(F.col(c).isin(*values), F.lit(False))
    return df.where(fit), df.where(~fit)

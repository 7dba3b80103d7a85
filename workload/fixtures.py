"""Inputs rendered from the supplied tables, and the same facts as SQL.

``corpus`` and ``headers`` write C text with decoy braces and calls in
comments, literals and directives.  The engine has to find in the text what
the SQL below states straight from the tables.  Every group that is collected
into one file is bounded by the recipe (1000 parts, 50000 orders), however the
tables grow; repeated calls of one callee are aggregated before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.arrays import quoted
from lodestone.session import shared_folder

ORDERS_PER_BLOCK = 50_000
PARTS_PER_FILE = 1_000

PROLOGUE = (
    "#include <stdio.h>\n"
    "#define M(x) { \\\n  skip(x)\n"
    "\n"
    "struct node { int id; char name[16]; };\n"
    "static int g_count = 0;\n"
    "\n"
)
HEADER_PROLOGUE = "/* struct decoy { int z; }; */\n#define OPEN_BRACE {\n"
BODY_TOP = (
    "{\n"
    "    /* } skip(1);\n"
    "       { */\n"
    "    const char *s = \"{ fake(2); }\"; // } x(3)\n"
)
BODY_END = "    return;\n}\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", "concat(lower(replace(p_brand, '#', '')), '/', lower(p_type)) AS folder",
        "concat(replace(p_name, ' ', '_'), '_', p_partkey % 100) AS name",
        "CASE p_partkey % 4 WHEN 0 THEN 'int ' WHEN 1 THEN 'static void ' WHEN 2 THEN 'char *' "
        "ELSE 'unsigned long ' END AS ret")


_kept: dict[tuple[str, str, str], str] = {}


def _once(name: str, render: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Render an input once for a session and folder; later queries read the written table."""
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = (spark.sparkContext.applicationId, sf_dir, name)
        if place not in _kept:
            _kept[place] = f"{shared_folder(spark).rstrip('/')}/rendered/{uuid.uuid4().hex}"
            render(spark, sf_dir).write.parquet(_kept[place])
        return spark.read.schema("path string, content string").parquet(_kept[place])

    return read


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.c`` files: path, content."""
    part = _part(spark, sf_dir)
    n_parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    sites = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", F.expr(f"l_orderkey div {ORDERS_PER_BLOCK}").alias("block"),
                ((F.col("l_partkey") + F.col("l_suppkey")) % n_parts).alias("callee_part"))
        .groupBy("l_partkey", "block", "callee_part").agg(F.count("*").alias("sites"))
    )
    callee = part.selectExpr(
        "p_partkey AS callee_part",
        "concat(CASE p_partkey % 10 WHEN 5 THEN 'ext_' WHEN 7 THEN 'lib_' ELSE '' END, name) AS callee")
    bodies = (
        sites.join(callee, "callee_part")
        .selectExpr("l_partkey", "block", "struct(callee_part, repeat(concat('    ', callee, '(1);\\n'), "
                    "CAST(sites AS int)) AS text) AS call")
        .groupBy("l_partkey", "block").agg(F.expr("array_join(array_sort(collect_list(call)).text, '')").alias("calls"))
    )
    functions = part.join(bodies, F.expr("p_partkey = l_partkey"), "left").selectExpr(
        f"concat('src/', folder, '/u', p_partkey div {PARTS_PER_FILE}, '_b', coalesce(block, 0), '.c') AS path",
        "struct(p_partkey, concat(ret, name, '(', CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'int a' "
        f"ELSE 'int a, char *b' END, ')\\n', {quoted(BODY_TOP)}, coalesce(calls, ''), {quoted(BODY_END)}, '\\n') "
        "AS text) AS item")
    return _rendered(functions, PROLOGUE)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.h`` files: path, content; one item per part."""
    items = _part(spark, sf_dir).selectExpr(
        f"concat('include/', folder, '/h', p_partkey div {PARTS_PER_FILE}, '.h') AS path",
        """struct(p_partkey, CASE p_partkey % 5
             WHEN 0 THEN concat(ret, CASE WHEN p_partkey % 10 = 5 THEN 'ext_' ELSE '' END, name, '(',
               CASE p_size % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'int a' WHEN 2 THEN 'int a, char *b'
                    ELSE 'int a, int (*cb)(int x, char y)' END, ');\\n')
             WHEN 1 THEN concat('struct s_', name,
               ' {\\n    int id;\\n    char *tag[16];\\n    struct s_other *next;\\n};\\n')
             WHEN 2 THEN concat('typedef unsigned int t_', name, ';\\n')
             WHEN 3 THEN concat('extern unsigned int g_', name, ', *h_', name, '[4];\\n')
             ELSE concat('typedef struct {\\n    long x, y;\\n} a_', name, ';\\n') END AS text) AS item""")
    return _rendered(items, HEADER_PROLOGUE)


#: Functions in conditional arms and with old-style heads, by p_partkey % 4; ``@`` is the part's name.
VARIANTS = [
    # two heads in two arms, one body
    "#ifdef WIDE\nint f_@(int a) {\n#else\nint f_@(long a) {\n#endif\n    g_@(1);\n}\n",
    # declarations between list and body
    "int o_@(a, b, c)\nint a;\nchar *b, c[4];\n{\n    h_@(a);\n}\n",
    # an open brace in each of three arms
    "static void b_@(void)\n{\n#if defined(A)\n    if (x) {\n        y_@(1);\n#elif defined(B)\n    if (z) {\n        z_@(2);\n"
    "#else\n    {\n#endif\n        w_@(3);\n    }\n}\n",
    # each arm closes the function
    "int c_@(void) {\n#ifdef A\n    p_@(1);\n}\n#else\n    q_@(2);\n}\n#endif\nint v_@;\n",
]


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.c`` files of :data:`VARIANTS`, one item per part: path, content."""
    text = F.replace(F.element_at(F.array(*map(F.lit, VARIANTS)), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("@"), F.col("name"))
    items = _part(spark, sf_dir).select(
        F.concat(F.lit("variants/"), "folder", F.lit("/v"), F.floor(F.col("p_partkey") / PARTS_PER_FILE), F.lit(".c")).alias("path"),
        F.struct("p_partkey", text.alias("text")).alias("item"))
    return _rendered(items, "")


def _rendered(items: DataFrame, prologue: str) -> DataFrame:
    return items.groupBy("path").agg(F.expr(
        f"concat({quoted(prologue)}, array_join(array_sort(collect_list(item)).text, ''))").alias("content"))


corpus, headers = _once("corpus", _corpus), _once("headers", _headers)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).unionByName(headers(spark, sf_dir))


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of :func:`sources` from the same tables and joins; no text is made or shuffled for them."""
    return _corpus(spark, sf_dir).select("path").unionByName(_headers(spark, sf_dir).select("path"))


def docfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file; the extension follows from the id."""
    return as_docfiles(table(spark, sf_dir, "documents"))


def as_docfiles(documents: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".c", ".h", ".txt", ".C")]),
                       (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))
    return documents.select(
        "doc_id", F.md5(path.cast("binary")).alias("file_key"), path.alias("path"),
        F.col("text").alias("content"))


# --------------------------------------------------------------------------
# The same facts in DuckDB SQL.  Each text is one or more CTEs.

def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_PART = """
nm AS (
  SELECT p_partkey, p_size,
         lower(replace(p_brand, '#', '')) || '/' || lower(p_type) AS folder,
         replace(p_name, ' ', '_') || '_' || (p_partkey % 100) AS name,
         CASE p_partkey % 4 WHEN 0 THEN 'int ' WHEN 1 THEN 'static void '
              WHEN 2 THEN 'char *' ELSE 'unsigned long ' END AS ret,
         CASE p_partkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'static void'
              WHEN 2 THEN 'char' ELSE 'unsigned long' END AS return_type,
         CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN 'int a' ELSE 'int a, char *b' END AS params
  FROM part)"""

SQL_CORPUS = SQL_PART + f""",
sites AS (
  SELECT l_partkey, l_orderkey // {ORDERS_PER_BLOCK} AS block,
         (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS callee_part, count(*) AS sites
  FROM lineitem GROUP BY ALL),
site_copies AS (
  SELECT l_partkey, block, callee_part, unnest(range(1, sites + 1)) AS copy FROM sites),
site_lines AS (
  SELECT s.l_partkey, s.block, s.callee_part, copy,
         CASE s.callee_part % 10 WHEN 5 THEN 'ext_' WHEN 7 THEN 'lib_' ELSE '' END || n.name AS callee,
         row_number() OVER (PARTITION BY s.l_partkey, s.block ORDER BY s.callee_part, copy) AS k
  FROM site_copies s JOIN nm n ON n.p_partkey = s.callee_part),
bodies AS (
  SELECT l_partkey, block, count(*) AS n_calls,
         string_agg('    ' || callee || '(1);' || chr(10), '' ORDER BY k) AS calls
  FROM site_lines GROUP BY ALL),
fn0 AS (
  SELECT n.*, coalesce(b.block, 0) AS block, coalesce(b.n_calls, 0) AS n_calls,
         'src/' || folder || '/u' || (p_partkey // {PARTS_PER_FILE}) || '_b' || coalesce(b.block, 0)
           || '.c' AS path,
         ret || name || '(' || params || ')' || chr(10) || {_sql_text(BODY_TOP)}
           || coalesce(b.calls, '') || {_sql_text(BODY_END)} AS snippet
  FROM nm n LEFT JOIN bodies b ON b.l_partkey = n.p_partkey),
fn AS (
  SELECT *, start_line + 6 + n_calls AS end_line FROM (
    SELECT *, CAST(8 + coalesce(sum(8 + n_calls) OVER (
             PARTITION BY path ORDER BY p_partkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_line,
           row_number() OVER (PARTITION BY path ORDER BY p_partkey) + 1 AS unit
    FROM fn0)),
call_site AS (
  SELECT f.path, f.name AS caller, f.start_line, f.end_line, f.p_partkey,
         f.start_line + 4 + s.k AS line, s.callee
  FROM site_lines s JOIN fn f ON f.p_partkey = s.l_partkey AND f.block = s.block),
corpus AS (
  SELECT path, {_sql_text(PROLOGUE)} || string_agg(snippet || chr(10), '' ORDER BY p_partkey) AS content
  FROM fn GROUP BY path)"""

_SQL_HEADERS_ONLY = f"""
hp AS (
  SELECT *, 'include/' || folder || '/h' || (p_partkey // {PARTS_PER_FILE}) || '.h' AS path,
         CASE p_size % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'int a' WHEN 2 THEN 'int a, char *b'
              ELSE 'int a, int (*cb)(int x, char y)' END AS hparams,
         CASE WHEN p_partkey % 10 = 5 THEN 'ext_' ELSE '' END || name AS declared,
         CASE p_partkey % 5 WHEN 1 THEN 5 WHEN 4 THEN 3 ELSE 1 END AS n_lines
  FROM nm),
item AS (
  SELECT *, CAST(3 + coalesce(sum(n_lines) OVER (PARTITION BY path ORDER BY p_partkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_line,
         row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1 AS unit,
         count(*) OVER (PARTITION BY path) AS n_units,
         CASE p_partkey % 5
           WHEN 0 THEN ret || declared || '(' || hparams || ');'
           WHEN 1 THEN 'struct s_' || name || ' {{' || chr(10) || '    int id;' || chr(10)
                || '    char *tag[16];' || chr(10) || '    struct s_other *next;' || chr(10) || '}};'
           WHEN 2 THEN 'typedef unsigned int t_' || name || ';'
           WHEN 3 THEN 'extern unsigned int g_' || name || ', *h_' || name || '[4];'
           ELSE 'typedef struct {{' || chr(10) || '    long x, y;' || chr(10) || '}} a_' || name || ';'
         END AS text
  FROM hp),
headers AS (
  SELECT path, {_sql_text(HEADER_PROLOGUE)} || string_agg(text || chr(10), '' ORDER BY p_partkey) AS content
  FROM item GROUP BY path)"""

SQL_HEADERS = SQL_PART + "," + _SQL_HEADERS_ONLY
# Both kinds of files, with one row per function in definitions-then-prototypes order.
SQL_SOURCES = SQL_CORPUS + "," + _SQL_HEADERS_ONLY + """,
files AS (SELECT path, content FROM corpus UNION ALL SELECT path, content FROM headers),
functions0 AS (
  SELECT path, name, return_type, params AS parameters, start_line, end_line,
         false AS is_prototype, snippet, unit AS ordinal
  FROM fn
  UNION ALL
  SELECT path, declared, return_type,
         CASE WHEN p_size % 4 = 3 THEN 'int a|int (*cb)(int x, char y)|int x|char y'
              ELSE replace(hparams, ', ', '|') END,
         start_line, start_line, true, text || chr(10), n_units + unit
  FROM item WHERE p_partkey % 5 = 0),
functions AS (
  SELECT path, name, return_type, replace(parameters, ', char *b', '|char *b') AS parameters,
         start_line, end_line, is_prototype, snippet, ordinal,
         md5(concat_ws('|', path, name, start_line, end_line, is_prototype)) AS function_key,
         md5(path) AS file_key, path || '::' || name AS qualified_name
  FROM functions0),
directory AS (
  SELECT name AS callee, function_key AS callee_key, qualified_name AS callee_name FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_prototype, path, ordinal) AS rn
    FROM functions) WHERE rn = 1),
first_in_file AS (
  SELECT path, name AS caller, function_key AS caller_key, qualified_name AS caller_name FROM (
    SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY ordinal) AS rn
    FROM functions) WHERE rn = 1),
all_edges AS (
  SELECT c.path, c.line, f.caller_key, f.caller_name, d.callee_key, d.callee_name
  FROM call_site c JOIN first_in_file f USING (path, caller) JOIN directory d USING (callee)),
edges AS (SELECT * FROM all_edges WHERE caller_key <> callee_key)"""

SQL_VARIANTS = SQL_PART + f""",
variant AS (
  SELECT *, CAST(1 + coalesce(sum(n_lines) OVER (PARTITION BY path ORDER BY p_partkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM (
    SELECT p_partkey, p_partkey % 4 AS kind, name, 'variants/' || folder || '/v' || (p_partkey // {PARTS_PER_FILE}) || '.c' AS path,
           CASE p_partkey % 4 {" ".join(f"WHEN {k} THEN {v.count(chr(10))}" for k, v in enumerate(VARIANTS))} END AS n_lines FROM nm)),
variant_function AS (
  SELECT path, v.name AS part_name, k.prefix || v.name AS name, k.return_type, k.parameters, line + k.first AS start_line, line + k.last AS end_line
  FROM variant v JOIN (VALUES
    (0, 'f_', 'int', 'int a', 1, 6), (1, 'o_', 'int', 'int a|char *b|char c[4]', 0, 5),
    (2, 'b_', 'static void', 'void', 0, 13), (3, 'c_', 'int', 'void', 0, 6)) k(kind, prefix, return_type, parameters, first, last) USING (kind)),
variant_call AS (
  SELECT path, line + k.place AS line, k.caller || v.name AS caller, k.callee || v.name AS callee
  FROM variant v JOIN (VALUES (0, 5, 'f_', 'g_'), (1, 4, 'o_', 'h_'), (2, 4, 'b_', 'y_'), (2, 7, 'b_', 'z_'), (2, 11, 'b_', 'w_'),
                              (3, 2, 'c_', 'p_'), (3, 5, 'c_', 'q_')) k(kind, place, caller, callee) USING (kind))"""

SQL_DOCFILES = """
docfiles AS (
  SELECT doc_id, md5(path) AS file_key, path, text AS content FROM (
    SELECT *, concat_ws('/', source, lang, doc_id ||
           CASE doc_id % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.h' WHEN 2 THEN '.txt' ELSE '.C' END) AS path
    FROM documents))"""


# --------------------------------------------------------------------------
# State tables

def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new snapshot of docfiles: French files are new, Spanish ones are gone,
    German ones have changed."""
    docs = docfiles(spark, sf_dir).withColumn("lang", F.split("path", "/")[1])
    changed = F.when(F.col("lang") == "de", F.concat("content", F.lit("\n// changed"))).otherwise(F.col("content"))
    old = docs.where("lang <> 'fr'").select("path", F.md5(F.col("content").cast("binary")).alias("content_hash"))
    new = docs.where("lang <> 'es'").select("path", F.md5(changed.cast("binary")).alias("content_hash"))
    return old, new


SQL_SNAPSHOTS = SQL_DOCFILES + """,
snaps AS (SELECT *, string_split(path, '/')[2] AS lang FROM docfiles),
changes AS (
  SELECT path, CASE lang WHEN 'fr' THEN 'added' WHEN 'es' THEN 'deleted' ELSE 'modified' END AS change
  FROM snaps WHERE lang IN ('fr', 'es', 'de'))"""


def old_sources(new: DataFrame) -> DataFrame:
    """The snapshot before ``sources``: brand7 is missing, brand8 differs, an extra folder
    with copies of brand9 exists."""
    is_brand = lambda b: F.split("path", "/")[1] == b
    edited = F.replace("content", F.lit("    return;\n"), F.lit("    return ;\n    old_call(1);\n"))
    kept = new.where(~is_brand("brand7")).withColumn(
        "content", F.when(is_brand("brand8"), edited).otherwise(F.col("content")))
    gone = new.where(is_brand("brand9")).withColumn("path", F.concat(F.lit("a_legacy/"), "path"))
    return kept.unionByName(gone)


def write_tree(files: DataFrame, root: str) -> None:
    """Write each file's text below ``root``; files that are there and not in ``files`` stay.

    A file is the one part in ``top=<first folder>/path=<escaped path>``.
    """
    rows = files.select(F.split("path", "/")[0].alias("top"), "path", F.regexp_replace("content", r"\n\z", "").alias("value"))
    rows.repartition("path").write.partitionBy("top", "path").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(root)


def path_in_tree():
    """The name of a file of :func:`write_tree`, from where it lies."""
    return F.url_decode(F.regexp_extract("path", "/path=([^/]+)/", 1))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of processed items: item_type, item_key, stage, commit_sha, ts."""
    kind = F.when(F.col("user_id") % 2 == 0, "file").otherwise("function")
    return table(spark, sf_dir, "events").select(
        kind.alias("item_type"), F.col("user_id").cast("string").alias("item_key"),
        F.lit("summarized").alias("stage"), F.col("event_type").alias("commit_sha"),
        F.date_trunc("second", "ts").alias("ts"))


SQL_STATUS = """
status_log AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'file' ELSE 'function' END AS item_type,
         CAST(user_id AS VARCHAR) AS item_key, 'summarized' AS stage, event_type AS commit_sha,
         date_trunc('second', ts) AS ts FROM events)"""


def status_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are done: commit c1 for labels of quality 1, c0 for the others."""
    doc = docfiles(spark, sf_dir).select("doc_id", "file_key")
    label = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "c1").otherwise("c0").alias("commit_sha"))
    return label.join(doc, "doc_id").select(
        F.lit("file").alias("item_type"), F.col("file_key").alias("item_key"),
        F.lit("summarized").alias("stage"), "commit_sha").distinct()


SQL_PROCESSED = SQL_DOCFILES + """,
processed AS (
  SELECT DISTINCT file_key, CASE WHEN quality = 1 THEN 'c1' ELSE 'c0' END AS commit_sha
  FROM labels JOIN docfiles USING (doc_id))"""


def summaries(spark: SparkSession, sf_dir: str, key: str = "file_key") -> tuple[DataFrame, DataFrame]:
    """Stored summaries, and updates for English documents and for new keys; every
    update comes twice and the second one counts."""
    doc = docfiles(spark, sf_dir)
    lang = F.split("path", "/")[1]
    refined = F.when(lang == "fr", "").when(lang == "es", None).otherwise(F.concat(F.lit("refined "), "content"))
    commit = F.concat(F.lit("c"), F.col("doc_id") % 2)
    old = doc.select(F.col("file_key").alias(key), commit.alias("commit_sha"),
                     F.col("content").alias("summary"), refined.alias("summary_refined"))
    keys = F.explode(F.when(lang == "en", F.array("file_key", F.md5(F.concat("file_key", F.lit("new")).cast("binary"))))
                     .otherwise(F.array(F.md5(F.concat("file_key", F.lit("new")).cast("binary")))))
    updates = doc.select(keys.alias(key), commit.alias("commit_sha"), "content").select(
        key, "commit_sha", "content", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select(
        key, "commit_sha", F.concat(F.lit("v"), "seq", F.lit(" "), "content").alias("summary"),
        F.lit("").alias("summary_refined"), "seq")
    return old, updates


SQL_SUMMARIES = SQL_DOCFILES + """,
summaries_old AS (
  SELECT file_key, 'c' || (doc_id % 2) AS commit_sha, content AS summary,
         CASE string_split(path, '/')[2] WHEN 'fr' THEN '' WHEN 'es' THEN NULL
              ELSE 'refined ' || content END AS summary_refined
  FROM docfiles),
summaries_new AS (
  SELECT k AS file_key, 'c' || (doc_id % 2) AS commit_sha, 'v2 ' || content AS summary,
         '' AS summary_refined
  FROM (SELECT *, unnest(CASE WHEN string_split(path, '/')[2] = 'en'
                              THEN [file_key, md5(file_key || 'new')] ELSE [md5(file_key || 'new')] END) AS k
        FROM docfiles))"""


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(F.lit(""), F.lit(".git"), F.lit("/")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.concat("url", ending).alias("git_url"))


SQL_URLS = """
repo_urls AS (
  SELECT page_id AS seq, url || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.git' ELSE '/' END AS git_url
  FROM pages),
named AS (SELECT *, replace(string_split(rtrim(git_url, '/'), '/')[-1], '.git', '') AS repo_name FROM repo_urls),
safe AS (
  SELECT *, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(repo_name),
         '\\s+', '_', 'g'), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'project') AS safe_name
  FROM named),
registered AS (
  SELECT *, safe_name || CASE WHEN rn = 0 THEN '' ELSE '_' || rn END AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY safe_name ORDER BY seq) - 1 AS rn FROM safe))"""


def params_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('["int a'), F.col("p_size"), F.lit('", "char *'), F.replace("p_name", F.lit(" "), F.lit("_")),
                    F.when(F.col("p_partkey") % 7 == 0, '"').otherwise('"]'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("parameters"))


SQL_PARAMS = """
params_text AS (
  SELECT p_partkey AS id, 'int a' || p_size || '|char *' || replace(p_name, ' ', '_') AS decoded,
         p_partkey % 7 = 0 AS broken FROM part)"""


def py_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules in nested folders; some do not parse, one per folder is left out."""
    part = _part(spark, sf_dir)
    k = F.col("p_partkey")
    file = F.when(k % 11 == 0, F.lit("scan.py")).otherwise(F.concat(F.lit("m"), k, F.lit(".py")))
    folder = F.concat(F.when(k % 13 == 0, "build/").otherwise("lib/"), "folder", F.lit("/d"), F.floor(k / PARTS_PER_FILE),
                      F.when(k % 11 == 0, F.concat(F.lit("/s"), k)).otherwise(""))
    body = F.concat(
        F.lit("import os\n\nclass C_"), "name", F.lit(":\n    def inner(self):\n        pass\n\nasync def a_"), "name",
        F.lit("():\n    pass\n\ndef Main():\n    def nested(): pass\n\nif os:\n    def hidden(): pass\n"),
        F.when(k % 50 == 49, "def broken(:\n").otherwise(""))
    return part.select(F.concat(folder, F.lit("/"), file).alias("path"), body.alias("content"))


SQL_PY = SQL_PART + f""",
py AS (
  SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'build/' ELSE 'lib/' END || folder || '/d' || (p_partkey // {PARTS_PER_FILE})
         || CASE WHEN p_partkey % 11 = 0 THEN '/s' || p_partkey ELSE '' END AS dir,
         CASE WHEN p_partkey % 11 = 0 THEN 'scan' ELSE 'm' || p_partkey END AS module,
         p_partkey % 50 = 49 AS broken
  FROM nm),
py_symbols AS (
  SELECT dir || '/' || module || '.py' AS path, dir, module, kind, prefix || CASE prefix WHEN 'Main' THEN '' ELSE name END AS symbol
  FROM py CROSS JOIN (VALUES ('class', 'C_'), ('function', 'a_'), ('function', 'Main')) v(kind, prefix)
  WHERE NOT broken)"""

"""Queries over status, summaries, prompts, snapshots, registry and packages."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import extract, graph, packages, projects, prompts, quality, snapshots, status, summarize
from lodestone.plans import analysis
from lodestone.session import settled, shared_folder
from lodestone.sources import corpus as scan
from lodestone.schemas import DDL
from lodestone.sources.store import Store, upsert
from lodestone.streaming import ingest
from workload import fixtures as fx
from workload.registry import query
from workload.structure import _SQL_SYMBOLS, _stored_functions

# -- status -------------------------------------------------------------------


@query("incremental_scan", f"""WITH {fx.SQL_PROCESSED}
SELECT file_key, path FROM docfiles WHERE (path LIKE '%.c' OR path LIKE '%.h')
  AND file_key NOT IN (SELECT file_key FROM processed WHERE commit_sha = 'c1')""")
def incremental_scan(spark, d):
    listed = scan.scan_table(fx.docfiles(spark, d)).select("file_key", "path")
    return status.unprocessed(listed, "file_key", fx.status_commits(spark, d), "file", "c1")


@query("unprocessed_files", f"""WITH {fx.SQL_PROCESSED}
SELECT file_key, path FROM docfiles WHERE file_key NOT IN (SELECT file_key FROM processed WHERE commit_sha = 'c0')""")
def unprocessed_files(spark, d):
    return status.unprocessed(fx.docfiles(spark, d).select("file_key", "path"), "file_key",
                              fx.status_commits(spark, d), "file", "c0", status.SUMMARIZED)


@query("processed_items", f"""WITH {fx.SQL_PROCESSED}
SELECT file_key, path, file_key IN (SELECT file_key FROM processed WHERE commit_sha = 'c1') AS is_done FROM docfiles""")
def processed_items(spark, d):
    docs = fx.docfiles(spark, d).select("file_key", "path")
    log = fx.status_commits(spark, d)
    done = status.processed(docs, "file_key", log, "file", "c1").withColumn("is_done", F.lit(True))
    open_ = status.unprocessed(docs, "file_key", log, "file", "c1").withColumn("is_done", F.lit(False))
    return done.unionByName(open_)


def _function_status(fns):
    """Functions whose hash starts with a digit are done at c1, the others at c0."""
    return fns.select(F.lit("function").alias("item_type"), F.col("function_key").alias("item_key"),
                      F.lit("summarized").alias("stage"),
                      F.when(F.col("code_hash") < "a", "c1").otherwise("c0").alias("commit_sha"))


@query("unprocessed_functions", f"""WITH {fx.SQL_SOURCES}
SELECT function_key, snippet AS code_snippet FROM functions WHERE NOT md5(snippet) < 'a'""")
def unprocessed_functions(spark, d):
    fns = extract.functions(_stored_functions(spark, d))
    return status.unprocessed(fns, "function_key", _function_status(fns), "function", "c1").select(
        "function_key", "code_snippet")


@query("functions_missing_summary", f"""WITH {fx.SQL_SOURCES}
SELECT function_key, path, name FROM functions WHERE md5(snippet) < 'a'""")
def functions_missing_summary(spark, d):
    fns = extract.functions(_stored_functions(spark, d))
    stored = _function_status(fns).select(F.col("item_key").alias("function_key"), "commit_sha")
    return status.without_summary(fns, "function_key", stored, "c0").select("function_key", "path", "name")


@query("mark_processed", f"""WITH {fx.SQL_STATUS},
items AS (SELECT item_type, item_key, min(ts) AS first_seen_at FROM status_log GROUP BY ALL)
SELECT l.item_type, l.item_key, l.stage, l.commit_sha, i.first_seen_at, max(l.ts) AS last_updated_at
FROM status_log l JOIN items i USING (item_type, item_key) GROUP BY ALL""")
def mark_processed(spark, d):
    """The log arrives in two halves, merged one after the other."""
    log = fx.status_log(spark, d)
    first, second = log.where("item_type = 'file'"), log.where("item_type = 'function'")
    both = first.unionByName(second)
    items = status.merge_items(status.merge_items(
        first.select("item_type", "item_key", F.col("ts").alias("first_seen_at")), first), both)
    commits = status.merge_commits(status.merge_commits(
        first.select("item_type", "item_key", "stage", "commit_sha", F.col("ts").alias("last_updated_at")),
        second), both)
    return commits.join(items, status.ITEM)


@query("item_status", f"""WITH {fx.SQL_STATUS},
items AS (SELECT item_type, item_key, min(ts) AS first_seen_at FROM status_log GROUP BY ALL),
commits AS (SELECT item_type, item_key, stage, commit_sha, max(ts) AS last_updated_at FROM status_log
            WHERE commit_sha <> 'view' GROUP BY ALL)
SELECT item_type, item_key, first_seen_at, stage, commit_sha, last_updated_at
FROM items LEFT JOIN commits USING (item_type, item_key)""")
def item_status(spark, d):
    log = fx.status_log(spark, d)
    items = log.groupBy(*status.ITEM).agg(F.min("ts").alias("first_seen_at"))
    commits = log.where("commit_sha <> 'view'").groupBy(*status.ITEM, "stage", "commit_sha").agg(
        F.max("ts").alias("last_updated_at"))
    return status.history(items, commits)


@query("stage_counts", f"""WITH {fx.SQL_SOURCES}
SELECT 'files' AS stage, count(*) AS n FROM files
UNION ALL SELECT 'definitions', count(*) FROM functions WHERE NOT is_prototype
UNION ALL SELECT 'prototypes', count(*) FROM functions WHERE is_prototype
UNION ALL SELECT 'call_sites', count(*) FROM call_site
UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'unprocessed_files', count(*) FROM files
UNION ALL SELECT 'unprocessed_functions', count(*) FROM functions WHERE NOT md5(snippet) < 'a'""")
def stage_counts(spark, d):
    """Observed while the tables are written."""
    store = _store(spark)
    store.replace("files", scan.with_hash(fx.sources(spark, d)))
    u = store.replace("units", extract.lean(extract.units(store.read("files"))))
    fns = store.replace("functions", extract.functions(u), definitions=F.count_if(F.expr("NOT is_prototype")),
                        prototypes=F.count_if("is_prototype"))
    sites = store.replace("call_sites", graph.call_sites(u))
    store.replace("function_calls", analysis.edges_of(sites, graph.directory(fns)))
    done = _function_status(fns)
    store.replace("first_pass_files", status.unprocessed(store.read("files"), "file_key", done, "file", "c1"))
    store.replace("first_pass_functions", status.unprocessed(fns, "function_key", done, "function", "c1"))
    return spark.createDataFrame(list(analysis.stage_metrics(store).items()), "stage string, n bigint")


def _store(spark):
    store = Store(spark, f"{shared_folder(spark).rstrip('/')}/stores/{uuid.uuid4().hex}")
    store.bootstrap()
    return store


@query("store_tables", f"""WITH {fx.SQL_DOCFILES}
SELECT 'files' AS "table", (SELECT count(*) FROM docfiles) AS n UNION ALL SELECT 'projects', count(*) FROM pages
{" ".join(f"UNION ALL SELECT '{t}', 0" for t in DDL if t not in ("files", "projects"))}""")
def store_tables(spark, d):
    """Every declared table of a new store, two of them filled by appends."""
    store = _store(spark)
    docs = scan.with_hash(fx.docfiles(spark, d).drop("file_key"))
    for half in (0, 1):
        store.append("files", docs.where(F.length("path") % 2 == half))
    store.append("projects", projects.register(fx.repo_urls(spark, d), "/srv/projects"))
    counts = [store.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in DDL]
    return functools.reduce(DataFrame.unionByName, counts)


# -- summaries ----------------------------------------------------------------

@query("upsert_file_summary", f"""WITH {fx.SQL_SUMMARIES}
SELECT * FROM summaries_new UNION ALL
SELECT * FROM summaries_old o WHERE NOT EXISTS (
  SELECT 1 FROM summaries_new n WHERE n.file_key = o.file_key AND n.commit_sha = o.commit_sha)""")
def upsert_file_summary(spark, d):
    old, updates = fx.summaries(spark, d)
    return upsert(old, updates, ["file_key", "commit_sha"], "seq")


@query("upsert_function_summary", f"""WITH {fx.SQL_SUMMARIES}
SELECT file_key AS function_key, commit_sha, summary, summary_refined FROM (
  SELECT * FROM summaries_new UNION ALL
  SELECT * FROM summaries_old o WHERE NOT EXISTS (
    SELECT 1 FROM summaries_new n WHERE n.file_key = o.file_key AND n.commit_sha = o.commit_sha))""")
def upsert_function_summary(spark, d):
    """Applied twice: the second time changes nothing."""
    old, updates = fx.summaries(spark, d, "function_key")
    key = ["function_key", "commit_sha"]
    return upsert(upsert(old, updates, key, "seq"), updates, key, "seq")


@query("best_summary", f"""WITH {fx.SQL_SUMMARIES}
SELECT file_key, commit_sha, CASE WHEN summary_refined <> '' THEN summary_refined ELSE summary END AS best
FROM summaries_old""")
def best_summary(spark, d):
    return fx.summaries(spark, d)[0].select(
        "file_key", "commit_sha", text.best_summary("summary_refined", "summary").alias("best"))


@query("summaries_at_commit", f"""WITH {fx.SQL_SUMMARIES}
SELECT file_key, summary FROM summaries_old WHERE commit_sha = 'c1'""")
def summaries_at_commit(spark, d):
    return fx.summaries(spark, d)[0].where("commit_sha = 'c1'").select("file_key", "summary")


@query("params_decode", f"""WITH {fx.SQL_PARAMS}
SELECT id, CASE WHEN broken THEN '' ELSE decoded END AS parameters FROM params_text""")
def params_decode(spark, d):
    return fx.params_text(spark, d).select("id", text.decode_parameters("parameters").alias("parameters"))


_SQL_FILE_PROMPT = """
sections AS (
  SELECT path,
    string_agg('- ' || symbol_name || ':' || chr(10) || '    ' || replace(code_snippet, chr(10), chr(10) || '    '),
               chr(10) ORDER BY k) FILTER (symbol_type = 'struct') AS structs,
    string_agg('- ' || symbol_name || ':' || chr(10) || '    ' || replace(code_snippet, chr(10), chr(10) || '    '),
               chr(10) ORDER BY k) FILTER (symbol_type = 'typedef') AS typedefs,
    string_agg('- ' || code_snippet || ' ' || symbol_name, chr(10) ORDER BY k, symbol_name)
               FILTER (symbol_type = 'global') AS globals
  FROM symbols
  GROUP BY path),
prompts AS (
  SELECT f.path, f.content, 'This is a C ' || CASE WHEN f.path LIKE '%.h' THEN 'header file' ELSE 'source file' END
    || ' at ' || f.path || ', with extracted data structures, typedefs, and globals.' || chr(10)
    || 'Summarize the file’s purpose and usage. Keep it concise.' || chr(10) || chr(10)
    || 'Structures:' || chr(10) || coalesce(structs, 'None') || chr(10) || chr(10)
    || 'Typedefs:' || chr(10) || coalesce(typedefs, 'None') || chr(10) || chr(10)
    || 'Globals:' || chr(10) || coalesce(globals, 'None') || chr(10) || chr(10)
    || '=== CODE START ===' || chr(10) || f.content || chr(10) || '=== CODE END ===' || chr(10) AS prompt
  FROM files f LEFT JOIN sections USING (path))"""


def _refine_sql(summary: str) -> str:
    return f"""'Below is the initial summary for file ' || path || ':' || chr(10) || chr(10)
    || '=== INITIAL SUMMARY ===' || chr(10) || {summary} || chr(10) || '=== END INITIAL SUMMARY ===' || chr(10) || chr(10)
    || 'Refine or improve the summary for correctness and brevity.' || chr(10) || chr(10)
    || '=== CODE START ===' || chr(10) || content || chr(10) || '=== CODE END ===' || chr(10)"""


_SQL_FN_PROMPT = """'Below is a single C function:' || chr(10) || chr(10) || '=== FUNCTION CODE ===' || chr(10)
    || snippet || chr(10) || '=== CODE END ===' || chr(10) || chr(10)
    || 'Summarize its purpose, inputs, outputs, and key logic. Keep it concise.' || chr(10)"""


def _fn_refine_sql(summary: str) -> str:
    return f"""'Initial summary of the function:' || chr(10) || {summary} || chr(10) || chr(10)
    || 'Refine or improve it, focusing on correctness and brevity.' || chr(10)"""


def _digest_sql(text: str) -> str:
    return f"(length({text}) || ' characters, ' || md5({text}))"


def _files_and_symbols(spark, d):
    files = scan.with_hash(fx.sources(spark, d))
    u = extract.for_symbols(extract.units(files)).where("text IS NOT NULL").select("path", "unit", "is_function", "text", "body")
    return files, extract.file_symbols(settled(u))


@query("file_prompt", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {_SQL_FILE_PROMPT}
SELECT path, length(prompt) AS n_chars, md5(prompt) AS prompt_hash FROM prompts""")
def file_prompt(spark, d):
    return prompts.file_prompts(*_files_and_symbols(spark, d)).select(
        "path", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_hash"))


@query("refine_prompt", f"""WITH {fx.SQL_DOCFILES}
SELECT path, md5({_refine_sql("content")}) AS prompt_hash FROM docfiles""")
def refine_prompt(spark, d):
    p = prompts.file_refine_prompt(F.col("path"), F.col("content"), F.col("content"))
    return fx.docfiles(spark, d).select("path", F.md5(p.cast("binary")).alias("prompt_hash"))


@query("function_prompt", f"""WITH {fx.SQL_SOURCES}
SELECT function_key, md5({_SQL_FN_PROMPT}) AS prompt_hash, md5({_fn_refine_sql("name")}) AS refine_hash FROM functions""")
def function_prompt(spark, d):
    fns = extract.functions(_stored_functions(spark, d))
    return fns.select(
        "function_key", F.md5(prompts.function_prompt(F.col("code_snippet")).cast("binary")).alias("prompt_hash"),
        F.md5(prompts.function_refine_prompt(F.col("name")).cast("binary")).alias("refine_hash"))


@query("summarizable_functions", f"""WITH {fx.SQL_DOCFILES}
SELECT path FROM docfiles WHERE regexp_matches(regexp_replace(content, '[A-Za-z]', '', 'g'), '[^\\s]')""")
def summarizable_functions(spark, d):
    """Letters are taken out of the texts, so that some of them become blank."""
    return summarize.summarizable(fx.docfiles(spark, d).select(
        "path", F.regexp_replace("content", "[A-Za-z]", "").alias("code_snippet"))).select("path")


@query("summarize_files", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {_SQL_FILE_PROMPT},
one AS (SELECT path, content, {_digest_sql("prompt")} AS s FROM prompts)
SELECT md5(path) AS file_key, 'c9' AS commit_sha, s AS summary, {_digest_sql(_refine_sql("s"))} AS summary_refined,
       CAST(NULL AS VARCHAR) AS error FROM one""")
def summarize_files(spark, d):
    done = summarize.summarize_files(*_files_and_symbols(spark, d), "c9", settle=settled)
    return done.select("file_key", "commit_sha", "summary", "summary_refined", "error")


@query("summarize_functions", f"""WITH {fx.SQL_SOURCES},
one AS (SELECT function_key, {_digest_sql(_SQL_FN_PROMPT)} AS s FROM functions)
SELECT function_key, 'c9' AS commit_sha, s AS summary, {_digest_sql(_fn_refine_sql("s"))} AS summary_refined,
       CAST(NULL AS VARCHAR) AS error FROM one""")
def summarize_functions(spark, d):
    fns = extract.functions(_stored_functions(spark, d))
    done = summarize.summarize_functions(fns, "c9")
    return done.select("function_key", "commit_sha", "summary", "summary_refined", "error")


_SQL_JOB = f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {_SQL_FILE_PROMPT},
one AS (SELECT path, content, {_digest_sql("prompt")} AS s FROM prompts),
fone AS (SELECT path, name, ordinal, {_digest_sql(_SQL_FN_PROMPT)} AS s FROM functions),
fns AS (SELECT path, string_agg(name || '=' || {_digest_sql(_fn_refine_sql("s"))}, '|' ORDER BY ordinal) AS functions FROM fone GROUP BY path),
syms AS (SELECT path, count(*) AS n_symbols FROM symbols GROUP BY path)
SELECT path, {_digest_sql(_refine_sql("s"))} AS file_summary, coalesce(functions, '') AS functions, coalesce(n_symbols, 0) AS n_symbols
FROM one LEFT JOIN fns USING (path) LEFT JOIN syms USING (path)"""


def _job_rows(code_map):
    return code_map.select(
        "path", "file_summary", F.array_join(F.transform("functions", lambda f: F.concat(f["name"], F.lit("="), f["func_summary"])), "|").alias("functions"),
        (F.size("structs") + F.size("typedefs") + F.size("globals")).alias("n_symbols"))


@query("full_job", _SQL_JOB)
def full_job(spark, d):
    """The whole analysis over a store: parse, resolve, summarise, view."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return _job_rows(analysis.full_analysis(_store(spark), scan.scan_table(fx.sources(spark, d)), "c1", now))


@query("refresh_job", _SQL_JOB)
def refresh_job(spark, d):
    """The analysis of an older snapshot, then a refresh to the present one (X2): as if analysed anew."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    store, new = _store(spark), fx.sources(spark, d)
    analysis.full_analysis(store, scan.scan_table(fx.old_sources(new)), "c0", now)
    return _job_rows(analysis.refresh(store, scan.scan_table(new), "c1", F.lit("2024-01-02 00:00:00").cast("timestamp")))


def _picky(requests, options):
    """Fails on every batch that holds a French text."""
    if any(r.system_prompt == "fr" for r in requests):
        raise ValueError("cannot read this")
    return summarize.digest(requests, options)


@query("summary_rejects", f"""WITH {fx.SQL_DOCFILES}
SELECT path, CASE WHEN lang = 'fr' THEN NULL ELSE {_digest_sql("content")} END AS summary,
       CASE WHEN lang = 'fr' THEN 'ValueError: cannot read this' END AS error
FROM (SELECT *, string_split(path, '/')[2] AS lang FROM docfiles)""")
def summary_rejects(spark, d):
    docs = fx.docfiles(spark, d).withColumn("lang", F.split("path", "/")[1])
    done = summarize.summarize(docs, ["path"], "content", _picky, system_prompt="lang", parallelism=8)
    return done.select("path", "summary", "error")


# Example texts; users give their own.
_MODE_TEXTS = {"c": "You read C code.", "asm": "You read assembly.", "file": "You read whole files."}


@query("summary_mode", f"""WITH {fx.SQL_DOCFILES}
SELECT path, mode, CASE mode WHEN 'c' THEN 'You read C code.' WHEN 'asm' THEN 'You read assembly.'
       WHEN 'file' THEN 'You read whole files.' ELSE 'Own text for ' || path END AS system_prompt
FROM (SELECT path, CASE string_split(path, '/')[2] WHEN 'en' THEN 'c' WHEN 'fr' THEN 'asm' WHEN 'de' THEN 'file'
             ELSE 'custom' END AS mode FROM docfiles)""")
def summary_mode(spark, d):
    lang = F.split("path", "/")[1]
    mode = F.when(lang == "en", "c").when(lang == "fr", "asm").when(lang == "de", "file").otherwise("custom")
    return summarize.with_mode(fx.docfiles(spark, d).select("path"), mode, _MODE_TEXTS,
                               F.concat(F.lit("Own text for "), "path"))


# -- snapshots ----------------------------------------------------------------

@query("changed_files", f"""WITH {fx.SQL_SNAPSHOTS} SELECT path, change FROM changes""")
def changed_files(spark, d):
    return snapshots.changed_files(*fx.snapshots(spark, d))


@query("files_to_refresh", f"""WITH {fx.SQL_SNAPSHOTS}
SELECT path, change FROM changes WHERE change <> 'deleted' AND (path LIKE '%.c' OR path LIKE '%.h')""")
def files_to_refresh(spark, d):
    return snapshots.files_to_refresh(snapshots.changed_files(*fx.snapshots(spark, d)))


@query("stream_ingest", f"""WITH {fx.SQL_DOCFILES}
SELECT file_key, path, md5(content) AS content_hash FROM docfiles WHERE path LIKE '%.c' OR path LIKE '%.h'""")
def stream_ingest(spark, d):
    """The documents table as a stream of files: all batches, then a restart that finds nothing new."""
    source = f"{d}/documents.parquet"
    schema = spark.read.parquet(source).schema
    folder = f"{shared_folder(spark)}/lodestone/{uuid.uuid4().hex}"
    # the file source takes a folder or a pattern: the pattern selects this table, be it one file or a folder of parts
    for _ in range(2):
        docs = spark.readStream.schema(schema).parquet(f"{d}/document[s].parquet")
        ingest.run(scan.scan_table(fx.as_docfiles(docs)).select("file_key", "path", "content_hash"),
                   f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{folder}/out")


# -- registry and packages ----------------------------------------------------

@query("ingest_edits", f"""WITH {fx.SQL_SOURCES},
brands AS (SELECT path, string_split(path, '/')[2] AS brand FROM files)
SELECT 'function' AS kind, path, name, CAST(start_line AS BIGINT) AS line FROM functions
UNION ALL SELECT 'added', path, '', 2 FROM brands WHERE brand = 'brand7'
UNION ALL SELECT 'edited', path, '', 2 FROM brands WHERE brand = 'brand8' AND path LIKE 'src/%'
UNION ALL SELECT 'deleted', 'a_legacy/' || path, '', 2 FROM brands WHERE brand = 'brand9'""")
def ingest_edits(spark, d):
    """A folder of sources, then new, edited, deleted and merely rewritten files; parsed as they changed."""
    new = settled(fx.sources(spark, d))
    folder = f"{shared_folder(spark).rstrip('/')}/edits/{uuid.uuid4().hex}"
    root, out, mark = (f"{folder}/{n}" for n in ("src", "out", "mark"))

    def run():
        return ingest.catch_up(spark, root, out, mark, "*.txt", fx.path_in_tree())

    fx.write_tree(fx.old_sources(new), root)
    run()
    fx.write_tree(new.where("split(path, '/')[1] IN ('brand7', 'brand8', 'brand10')"), root)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/top=a_legacy")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    units = run()
    changes = ingest.folder_changes(spark, out).where("run = 2")
    return extract.functions(units).select(F.lit("function").alias("kind"), "path", "name", F.col("start_line").alias("line")).unionByName(
        changes.select(F.col("change").alias("kind"), "path", F.lit("").alias("name"), F.col("run").alias("line")))


@query("repo_name", f"""WITH {fx.SQL_URLS} SELECT seq, repo_name FROM named""")
def repo_name(spark, d):
    return fx.repo_urls(spark, d).select("seq", text.repository_name("git_url").alias("repo_name"))


@query("safe_name", f"""WITH {fx.SQL_URLS} SELECT seq, safe_name FROM safe""")
def safe_name(spark, d):
    return fx.repo_urls(spark, d).select("seq", text.safe_name(text.repository_name("git_url")).alias("safe_name"))


@query("unique_project_names", f"""WITH {fx.SQL_URLS} SELECT seq, safe_name, name FROM registered""")
def unique_project_names(spark, d):
    base = text.safe_name(text.repository_name("git_url"))
    return projects.unique_names(fx.repo_urls(spark, d).select("seq", base.alias("safe_name")), "safe_name", "seq")


_SQL_PROJECTS = f"""WITH {fx.SQL_URLS}
SELECT name, '/projects/' || name AS path, git_url, CAST(NULL AS VARCHAR) AS last_commit,
       'database/' || name || '.db' AS store_path FROM registered"""


@query("project_register", _SQL_PROJECTS)
def project_register(spark, d):
    return projects.register(fx.repo_urls(spark, d), "/projects")


@query("project_register_known", f"""WITH {fx.SQL_URLS},
later AS (SELECT *, row_number() OVER (PARTITION BY safe_name ORDER BY seq % 2 DESC, seq) - 1 AS n FROM safe)
SELECT name, '/projects/' || name AS path, git_url FROM (
  SELECT safe_name || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS name, git_url, seq FROM later) WHERE seq % 2 = 0""")
def project_register_known(spark, d):
    """The pages of even number, against a registry that holds the odd ones."""
    urls = fx.repo_urls(spark, d)
    known = settled(projects.register(urls.where("seq % 2 = 1"), "/projects"))
    return projects.register(urls.where("seq % 2 = 0"), "/projects", known=known).select("name", "path", "git_url")


@query("project_list", _SQL_PROJECTS)
def project_list(spark, d):
    return projects.list_projects(settled(projects.register(fx.repo_urls(spark, d), "/projects/")))


@query("py_symbols", f"""WITH {fx.SQL_PY}
SELECT path, kind, symbol AS name, CAST(NULL AS VARCHAR) AS error FROM py_symbols
UNION ALL SELECT dir || '/' || module || '.py', 'reject', NULL, 'SyntaxError' FROM py WHERE broken""")
def py_symbols(spark, d):
    return packages.py_symbols(fx.py_files(spark, d)).drop("ordinal")


@query("package_exports", f"""WITH {fx.SQL_PY},
own AS (SELECT * FROM py_symbols WHERE symbol <> 'Main' AND module <> 'scan' AND dir NOT LIKE 'build/%'),
up AS (SELECT DISTINCT string_split(dir, '/') AS p FROM own),
nested AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM up),
rows AS (
  SELECT DISTINCT dir AS folder, kind, module, symbol AS name FROM own
  UNION ALL SELECT DISTINCT array_to_string(p[1:i - 1], '/'), 'folder', NULL, p[i] FROM nested)
SELECT folder, replace(folder, '/', '.') AS package, kind, module, name FROM rows""")
def package_exports(spark, d):
    return packages.package_exports(packages.py_symbols(fx.py_files(spark, d)))


# -- constraints --------------------------------------------------------------

def _broken_tables(spark, d):
    """Tables of the sources with files of brand3 missing, summaries for unknown functions and an unknown commit."""
    sources = scan.with_hash(fx.sources(spark, d))
    u = settled(extract.for_symbols(extract.units(sources)))
    fns = settled(extract.functions(u).select("function_key", "file_key", "path", "name", "is_prototype", "ordinal"))
    calls = settled(analysis.edges_of(graph.call_sites(u), graph.directory(fns)))
    _, updates = fx.summaries(spark, d)
    commits = spark.range(2).select(F.concat(F.lit("c"), "id").alias("commit_sha"))
    texts = fns.where("is_prototype").select(F.md5(F.concat("function_key", F.lit("gone")).cast("binary")).alias("function_key"), F.lit("c7").alias("commit_sha"))
    return {"files": sources.where(~F.col("path").contains("/brand3/")), "file_symbols": extract.file_symbols(u), "functions": fns,
            "function_calls": calls, "function_summaries": texts, "commits": commits, "file_summaries": updates}


@query("fk_orphans", f"""WITH {fx.SQL_SOURCES}, {_SQL_SYMBOLS}, {fx.SQL_SUMMARIES.strip()},
known AS (SELECT md5(path) AS file_key FROM files WHERE path NOT LIKE '%/brand3/%'),
one AS (
  SELECT 'file_symbols' AS "table", 'file_key' AS "column", file_key AS key FROM symbols WHERE path LIKE '%/brand3/%'
  UNION ALL SELECT 'functions', 'file_key', file_key FROM functions WHERE path LIKE '%/brand3/%'
  UNION ALL SELECT 'function_summaries', 'function_key', md5(function_key || 'gone') FROM functions WHERE is_prototype
  UNION ALL SELECT 'function_summaries', 'commit_sha', 'c7' FROM functions WHERE is_prototype
  UNION ALL SELECT 'file_summaries', 'file_key', file_key FROM summaries_new, range(2))  -- every update comes twice
SELECT "table", "column", key, count(*) AS n FROM one GROUP BY ALL""")
def fk_orphans(spark, d):
    """All references at once (Q1); summaries of documents refer to files that are no sources."""
    return quality.all_orphans(_broken_tables(spark, d))


@query("unique_violations", f"""WITH {fx.SQL_SOURCES}, {fx.SQL_SUMMARIES.strip()},
{fx.SQL_STATUS.strip()}, {fx.SQL_URLS.strip()},
names AS (SELECT safe_name AS name FROM safe),
copies AS (SELECT path FROM files UNION ALL SELECT path FROM files WHERE path LIKE '%.h'),
fns AS (SELECT function_key FROM functions UNION ALL SELECT function_key FROM functions WHERE path LIKE '%.h')
SELECT 'file_summaries' AS "table", file_key || '|' || commit_sha AS key, count(*) AS n FROM summaries_new, range(2)
  GROUP BY file_key, commit_sha
UNION ALL SELECT 'status_commits', item_type || '|' || item_key || '|' || stage || '|' || commit_sha, count(*) FROM status_log
  GROUP BY item_type, item_key, stage, commit_sha HAVING count(*) > 1
UNION ALL SELECT 'projects', name, count(*) FROM names GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'files', path, count(*) FROM copies GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'functions', function_key, count(*) FROM fns GROUP BY function_key HAVING count(*) > 1""")
def unique_violations(spark, d):
    """Unique keys of all tables (Q3): headers come twice, updates come twice, names are not yet unique."""
    _, updates = fx.summaries(spark, d)
    files = fx.sources(spark, d)
    fns = settled(extract.functions(settled(extract.for_graph(extract.units(files)))).select("function_key", "path"))
    header = F.col("path").endswith(".h")
    names = fx.repo_urls(spark, d).select(text.safe_name(text.repository_name("git_url")).alias("name"))
    return quality.all_duplicates({
        "file_summaries": updates, "status_commits": fx.status_log(spark, d), "projects": names,
        "files": files.unionByName(files.where(header)), "functions": fns.unionByName(fns.where(header))})

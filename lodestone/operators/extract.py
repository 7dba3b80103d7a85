"""Records of C source files: functions, prototypes, structs, typedefs, globals, calls.

All steps are per unit (see :mod:`lodestone.operators.segment`), hence map-only.
Tokens of a unit are an array ``z`` of ``struct<i, t, d>``: position, text and
bracket depth before the token.  ``z_raw`` holds for each position the text with
the blanks and comments in front of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexis
from lodestone.functions.arrays import (
    each, first_index, last_index, let, picked, quoted, split_where, struct, those, word_list,
)
from lodestone.functions.segments import BRACE, FLAGS, START, STOP, bracket_depth, function_head, token_marks
from lodestone.operators import segment
from lodestone.operators.segment import parsed_files

ANONYMOUS, COMPLEX, UNKNOWN_TYPE = "<anonymous>", "<complex type>", "<unknown_type>"

_ATTRIBUTES = word_list(lexis.ATTRIBUTE_WORDS)
_TAGS = word_list(lexis.TAG_WORDS)


# -- tokens ------------------------------------------------------------------

def with_tokens(df: DataFrame, **texts: str) -> DataFrame:
    """Adds the tokens of each SQL expression as the column ``name``, and apart ``name``_raw,
    _tok and _depth, so that they are only made where they are read."""
    pattern = quoted(lexis.TOKEN)
    kept = df.columns
    df = df.withColumns({f"{n}_tok": F.expr(f"regexp_extract_all({t}, {pattern}, 1)") for n, t in texts.items()})
    df = df.withColumns({f"{n}_raw": F.expr(f"regexp_extract_all({t}, {pattern}, 0)") for n, t in texts.items()})
    # one pass through Python for all of them; a null list would be looked at again with each row that follows in its batch
    df = df.withColumns({f"{n}_depth": bracket_depth(F.expr(f"coalesce({n}_tok, array())")) for n in texts})
    zipped = [F.expr(each(f"{n}_tok", lambda t, i: struct(i=i, t=t, d=f"get({n}_depth, {i})"))).alias(n) for n in texts]
    return df.select(*kept, *[f"{n}_{c}" for n in texts for c in ("raw", "tok", "depth")], *zipped)


def with_heads(df: DataFrame, **texts: str) -> DataFrame:
    """As :func:`with_tokens` for texts of function heads, with what each declares as ``name``_head."""
    pattern = quoted(lexis.TOKEN)
    kept = df.columns
    df = df.withColumns({f"{n}_tok": F.expr(f"regexp_extract_all({t}, {pattern}, 1)") for n, t in texts.items()})
    df = df.withColumns({f"{n}_raw": F.expr(f"regexp_extract_all({t}, {pattern}, 0)") for n, t in texts.items()})
    df = df.withColumns({f"{n}_head": function_head(F.expr(f"coalesce({n}_tok, array())")) for n in texts})
    zipped = [F.expr(each(f"{n}_tok", lambda t, i: struct(i=i, t=t, d=f"get({n}_head.depth, {i})"))).alias(n) for n in texts]
    return df.select(*kept, *[f"{n}_{c}" for n in texts for c in ("raw", "head")], *zipped)


def _source_text(tokens: str, raw: str = "z_raw") -> str:
    """Text of the tokens without what stands in front of the first one."""
    rest = each(f"slice({tokens}, 2, greatest(size({tokens}), 1))", lambda x: f"get({raw}, {x}.i)")
    return f"concat(get({tokens}, 0).t, array_join({rest}, ''))"


def _token(z: str, i: str) -> str:
    """Text of the token at a position, empty outside of the tokens."""
    return f"coalesce(get({z}, {i}).t, '')"


def _is_word(x: str) -> str:
    return f"({x}.t RLIKE {quoted(lexis.WORD)} AND {x}.t NOT IN ({_ATTRIBUTES}))"


def _is_name(x: str) -> str:
    return f"({_is_word(x)} AND {x}.t NOT IN ({_TAGS}))"


# -- declarators -------------------------------------------------------------

def _declarator(z: str, base: str) -> str:
    """``int (*f)(void)`` and the like -> struct<name, at, type, is_function, is_variable>.

    ``base`` is the bracket depth of the declaration, ``at`` the position of the
    name in ``z``; both are null when nothing is declared.
    """
    def flat(x: str) -> str:
        return f"{x}.d = {base}"

    marks = struct(
        paren=first_index(z, lambda x, i: f"{x}.t = '(' AND {flat(x)} AND {_token(z, f'{i} - 1')} NOT IN ({_ATTRIBUTES})"),
        cut=first_index(z, lambda x, i: f"{flat(x)} AND {x}.t IN ('=', '[', ':')"),
        star=first_index(z, lambda x, i: f"{flat(x)} AND {x}.t = '*'"))

    def with_marks(m: str) -> str:
        has_paren = f"({m}.paren IS NOT NULL AND ({m}.cut IS NULL OR {m}.paren < {m}.cut))"
        close = first_index(z, lambda x, i: f"{i} > {m}.paren AND {x}.t = ')' AND {x}.d = {base} + 1")
        closing = f"CASE WHEN {has_paren} THEN {close} END"
        return let(struct(after=f"coalesce(get({z}, {closing} + 1).t, '')", has=has_paren), lambda c: with_close(m, c))

    def with_close(m: str, c: str) -> str:
        grouped = f"({c}.has AND ({c}.after IN ('(', '[') OR {_token(z, f'{m}.paren + 1')} = '*'))"
        inner = first_index(z, lambda x, i: f"{i} > {m}.paren AND {_is_name(x)}")
        plain = last_index(z, lambda x, i: f"{i} < coalesce({m}.cut, size({z})) AND {flat(x)} AND {_is_name(x)}")
        at = f"CASE WHEN {grouped} THEN {inner} WHEN {c}.has THEN {m}.paren - 1 ELSE {plain} END"
        return let(struct(at=at, grouped=grouped), lambda g: with_name(m, c, g))

    def with_name(m: str, c: str, g: str) -> str:
        a = f"{g}.at"
        ok = (f"({a} IS NOT NULL AND {_token(z, f'{a} - 1')} NOT IN ({_TAGS}) "
              f"AND coalesce({_is_name(f'get({z}, {a})')}, false))")
        end = f"least({a}, {m}.star, CASE WHEN {g}.grouped THEN {m}.paren END)"
        words = each(those(f"slice({z}, 1, greatest(coalesce({end}, 0), 0))", lambda x: f"{flat(x)} AND {_is_word(x)}"),
                     lambda x: f"{x}.t")
        return struct(
            name=f"CASE WHEN {ok} THEN get({z}, {a}).t END", at=f"CASE WHEN {ok} THEN {a} END",
            type=f"array_join({words}, ' ')",
            is_function=f"({ok} AND {c}.has AND (NOT {g}.grouped OR {c}.after = '('))",
            is_variable=f"({ok} AND {_token(z, f'{a} + 1')} <> '(')")

    return let(marks, with_marks)


def _parts(z: str, base: str) -> str:
    """Declarators of one statement: array of tokens per comma-separated part."""
    return split_where(z, lambda x: f"{x}.t = ',' AND {x}.d = {base}")


def _declared(z: str, base: str) -> str:
    """Every declarator of a statement with its tokens; all carry the type words of
    the first part."""
    found = each(_parts(z, base), lambda p: struct(p=p, d=_declarator(p, base)))
    return let(found, lambda ds: each(ds, lambda x: struct(
        name=f"{x}.d.name", at=f"{x}.d.at", type=f"get({ds}, 0).d.type",
        is_function=f"{x}.d.is_function", is_variable=f"{x}.d.is_variable", tokens=f"{x}.p")))


def _parameters(z: str) -> str:
    """Source text of each parameter; those of function-pointer parameters follow their parent."""
    def opens(x: str, i: str) -> str:
        before = f"get({z}, {i} - 1)"
        return (f"{x}.t = '(' AND {i} > 0 AND ({_is_word(before)} OR {before}.t = ')') "
                f"AND {_token(z, f'{i} + 1')} <> '*'")

    def closing(x: str, i: str) -> str:
        return first_index(z, lambda y, j: f"{j} > {i} AND {y}.t = ')' AND {y}.d = {x}.d + 1")

    lists = those(
        picked(z, opens, lambda x, i: struct(open=i, close=closing(x, i), d=f"{x}.d + 1")),
        # a bracket before another argument list groups the declarator
        lambda r: f"{_token(z, f'{r}.close + 1')} <> '('")

    def of_list(r: str) -> str:
        inner = f"slice({z}, {r}.open + 2, greatest({r}.close - {r}.open - 1, 0))"
        return those(split_where(inner, lambda x: f"{x}.t = ',' AND {x}.d = {r}.d"),
                     lambda p: f"size({p}) > 0 AND get({p}, 0).t <> '...'")

    found = f"flatten({each(lists, of_list)})"
    return f"array_sort({each(found, lambda p: struct(i=f'get({p}, 0).i', text=_source_text(p)))}).text"


def _old_parameters(z: str, name_at: str) -> str:
    """Parameters of a head whose declarations stand behind the list: one per declared name."""
    close = first_index(z, lambda x, i: f"{i} > {name_at} AND {x}.t = ')' AND {x}.d = 1")
    statements = split_where(f"slice({z}, {close} + 2, size({z}))", lambda x: f"{x}.t = ';' AND {x}.d = 0")

    def of_statement(st: str) -> str:
        named = those(each(_declared(st, "0"), lambda d, i: struct(d=d, i=i)), lambda x: f"{x}.d.name IS NOT NULL")
        return each(named, lambda x: f"CASE WHEN {x}.i = 0 THEN {_source_text(f'{x}.d.tokens')} "
                                     f"ELSE concat(coalesce(nullif({x}.d.type, ''), 'int'), ' ', {_source_text(f'{x}.d.tokens')}) END")

    return f"flatten({each(those(statements, lambda st: f'size({st}) > 0'), of_statement)})"


# -- tables ------------------------------------------------------------------

def function_key(path: str, name: str, start: str, end: str, proto: str) -> str:
    return f"md5(concat_ws('|', {path}, {name}, {start}, {end}, {proto}))"


_SPAN = ["path", "unit", "n_units", "start_line", "end_line", "snippet"]
_RAW_UNIT = ["path", "n_units", "unit", "is_function", "start_line", "end_line", "text", "body", "snippet", "calls"]


def units(files: DataFrame) -> DataFrame:
    """The parsed table: one row per top-level unit of each ``(path, content)`` row.

    Adds to :func:`lodestone.operators.segment.units` what the head of a function
    declares (name, return_type, parameters) and ``cover_name``, the earlier
    function that holds its first line.  Columns that are not read are not made.
    """
    raw = segment.units(files)
    heads = with_heads(raw, z="CASE WHEN is_function THEN text END", zc="cover_text")
    return heads.selectExpr(
        *_RAW_UNIT, "CASE WHEN is_function THEN z_head.name END AS name",
        "CASE WHEN is_function THEN coalesce(nullif(z_head.type, ''), 'int') END AS return_type",
        f"CASE WHEN old_style THEN {_old_parameters('z', 'z_head.at')} WHEN is_function THEN {_parameters('z')} END AS parameters",
        "zc_head.name AS cover_name")


def for_graph(u: DataFrame) -> DataFrame:
    """The rows and columns of the parsed table that functions' names and calls are read from.

    Texts of functions, their bodies, snippets and parameters are null, so they are neither
    made nor stored; what is neither a function nor in a header has no row.
    """
    return u.where("is_function OR endswith(path, '.h')").withColumns({
        "text": F.expr("CASE WHEN NOT is_function THEN text END"), "body": F.lit(None).cast("string"),
        "snippet": F.lit(None).cast("string"), "parameters": F.lit(None).cast("array<string>")})


def for_functions(u: DataFrame) -> DataFrame:
    """The rows and columns of the parsed table that :func:`functions` reads, without calls and with the text of
    functions once, in their snippets."""
    none = {c: F.lit(None).cast(u.schema[c].dataType) for c in ("body", "calls", "cover_name")}
    return u.where("is_function OR endswith(path, '.h')").withColumns({"text": F.expr("CASE WHEN NOT is_function THEN text END"), **none})


def lean(u: DataFrame) -> DataFrame:
    """The parsed table without heads and bodies that no record is read from: those of functions that hold neither
    ``struct`` nor ``typedef``.  All rows and all other columns stay; the snippet has the whole text."""
    held = " OR ".join(["NOT is_function", *[f"contains({c}, '{word}')" for c in ("text", "body") for word in ("struct", "typedef")]])
    return u.withColumns({c: F.expr(f"CASE WHEN {held} THEN {c} END") for c in ("text", "body")})


def for_symbols(u: DataFrame) -> DataFrame:
    """:func:`lean` without snippets and parameters: what symbols, names and calls are read from."""
    return lean(u).withColumns({c: F.lit(None).cast(u.schema[c].dataType) for c in ("snippet", "parameters")})


def each_entry(df: DataFrame, items: str, name: str, *keep: str) -> DataFrame:
    """One row per entry.  The filter stays above the generator, so that the
    expression behind ``items`` is not evaluated a second time for it."""
    return df.selectExpr(*keep, f"explode_outer({items}) AS {name}").where(f"{name} IS NOT NULL")


def definitions(u: DataFrame) -> DataFrame:
    """Function definitions."""
    fns = each_entry(u.where("is_function"), those("array(name)", lambda n: f"{n} IS NOT NULL"), "declared",
                     *_SPAN, "return_type", "parameters")
    return fns.selectExpr(*_SPAN, "unit AS ordinal", "declared AS name", "return_type", "parameters")


def _declarations(u: DataFrame) -> DataFrame:
    """Units that are neither function definitions nor typedefs."""
    pattern = quoted(lexis.TRIVIA_AT_START + r"typedef\b")
    return u.where(f"NOT is_function AND NOT text RLIKE {pattern}")


def prototypes(u: DataFrame) -> DataFrame:
    """Function declarations of header files (E5)."""
    decl = _declarations(u).where("endswith(path, '.h')")
    decl = with_tokens(decl.select(*_SPAN, "text"), z="text")
    # a bare NAME(...); is a macro use, unless it follows another part
    found = those(_declared("z", "0"), lambda d: f"{d}.is_function AND ({d}.at > 0 OR get({d}.tokens, 0).i > 0)")
    rows = each_entry(decl, found, "d", *_SPAN, "z_raw")
    return rows.selectExpr(*_SPAN, "n_units + unit AS ordinal", "d.name AS name",
                           "coalesce(nullif(d.type, ''), 'int') AS return_type",
                           f"{_parameters('d.tokens')} AS parameters")


def functions(u: DataFrame) -> DataFrame:
    """Definitions, then prototypes: the functions table."""
    both = definitions(u).withColumn("is_prototype", F.lit(False)).unionByName(
        prototypes(u).withColumn("is_prototype", F.lit(True)))
    return both.selectExpr(
        f"{function_key('path', 'name', 'start_line', 'end_line', 'is_prototype')} AS function_key",
        "md5(path) AS file_key", "path", "coalesce(name, '') AS name",
        "coalesce(return_type, '') AS return_type", "parameters", "start_line", "end_line",
        "is_prototype", "md5(snippet) AS code_hash", "snippet AS code_snippet", "ordinal")


def _whole_units(u: DataFrame, pattern: str) -> DataFrame:
    """Units whose whole text (with the body) matches, tokenised as ``z``."""
    picked_ = u.selectExpr("path", "unit", "concat(text, coalesce(body, '')) AS whole")
    return with_tokens(picked_.where(f"whole RLIKE {quoted(pattern)}"), z="whole")


def _with_marks(df: DataFrame, start: str, stop: Callable[[str, str], str]) -> DataFrame:
    """Adds ``marks``: each word ``start`` with the next token of its depth for which ``stop``
    holds, and the brace that closes there.  One running pass, however many such words."""
    # from the stored arrays: "z" would be written out, and made again, at each place that reads it
    codes = each("z_tok", lambda t, i: f"get(z_depth, {i}) * {FLAGS} + CASE WHEN {t} = '{start}' THEN {START} "
                                       f"WHEN {t} = '}}' THEN {BRACE} WHEN {stop(t, i)} THEN {STOP} ELSE 0 END")
    return df.withColumn("marks", token_marks(F.expr(f"coalesce({codes}, array())")))


def structs(u: DataFrame) -> DataFrame:
    """Struct specifiers with a body, nested ones included, in text order."""
    df = _whole_units(u, r"\bstruct\b[^;{}]*+\{")

    def stop(t: str, i: str) -> str:
        """What ends the words after ``struct``."""
        return (f"{t} IN ('{{', ';', ')', ',', '=', '*') "
                f"OR ({t} = '(' AND coalesce(get(z_tok, {i} - 1), '') NOT IN ({_ATTRIBUTES}))")

    def texts(s: str) -> str:
        return struct(
            i=f"{s}.i", d=f"get(z, {s}.i).d", before=f"slice(z, {s}.i + 2, {s}.k - {s}.i - 1)",
            all=f"slice(z, {s}.i + 1, {s}.e - {s}.i + 1)", inner=f"slice(z, {s}.k + 2, {s}.e - {s}.k - 1)",
            # what follows the struct in a typedef names an untagged one
            after=f"CASE WHEN get(z, {s}.i).d = 0 AND get(z, 0).t = 'typedef' THEN slice(z, {s}.e + 2, size(z) - {s}.e - 2) END")

    df = _with_marks(df, "struct", stop)
    bodies = each(those("marks", lambda s: f"{_token('z', f'{s}.k')} = '{{'"), texts)
    rows = each_entry(df, bodies, "s", "path", "unit", "z_raw")

    tags = those("s.before", lambda x: f"{x}.d = s.d AND {_is_word(x)}")
    alias = f"get({_declared('s.after', 's.d')}, 0).name"
    statements = those(split_where("s.inner", lambda x: f"{x}.t = ';' AND {x}.d = s.d + 1"), lambda st: f"size({st}) > 0")
    fields = each(statements, lambda st: each(
        those(_declared(st, "s.d + 1"), lambda d: f"{d}.name IS NOT NULL"),
        lambda d: f"concat_ws(' ', coalesce(nullif({d}.type, ''), 'int'), {d}.name)"))
    return rows.selectExpr(
        "path", "unit AS ordinal", "s.i AS pos",
        f"coalesce(get(reverse({tags}), 0).t, {alias}, {quoted(ANONYMOUS)}) AS name",
        f"{_source_text('s.all')} AS code", f"flatten({fields}) AS fields")


def typedefs(u: DataFrame) -> DataFrame:
    """Type aliases, one row per name: alias, original type words, source text."""
    df = _whole_units(u, r"\btypedef\b")
    df = _with_marks(df, "typedef", lambda t, i: f"{t} = ';'")
    statements = each("marks", lambda m: struct(i=f"{m}.i", d=f"get(z, {m}.i).d", all=f"slice(z, {m}.i + 1, {m}.k - {m}.i + 1)"))
    rows = each_entry(df, those(statements, lambda s: f"size({s}.all) > 2"), "s", "path", "unit", "z_raw")
    names = those(_declared("slice(s.all, 2, size(s.all) - 2)", "s.d"), lambda d: f"{d}.name IS NOT NULL")
    rows = each_entry(rows, names, "d", "path", "unit", "s", "z_raw")
    return rows.selectExpr(
        "path", "unit AS ordinal", "s.i AS pos", "d.name AS alias",
        f"CASE WHEN exists(s.all, x -> x.t = '{{') OR d.type = '' THEN {quoted(COMPLEX)} ELSE d.type END AS original",
        f"{_source_text('s.all')} AS code")


def globals_(u: DataFrame) -> DataFrame:
    """Variables declared at file scope: name and type words."""
    decl = with_tokens(_declarations(u).select("path", "unit", "text"), z="text")
    statement = those("z", lambda x: f"{x}.t <> ';' OR {x}.d > 0")
    decl = decl.selectExpr("path", "unit", f"posexplode_outer({_declared(statement, '0')}) AS (pos, d)")
    # a lone word is a macro use, not a variable
    return decl.where("d.is_variable AND (d.at > 0 OR pos > 0)").selectExpr(
        "path", "unit AS ordinal", "pos", "d.name AS name",
        f"coalesce(nullif(d.type, ''), {quoted(UNKNOWN_TYPE)}) AS type")


def calls(u: DataFrame) -> DataFrame:
    """One row per call site: path, caller_line, callee_name."""
    return each_entry(u.where("is_function"), "calls", "c", "path").selectExpr(
        "path", "c.line AS caller_line", "c.name AS callee_name")


def file_symbols(u: DataFrame) -> DataFrame:
    """Structs, typedefs and globals in one table."""
    columns = ("md5(path) AS file_key", "path", "'{}' AS symbol_type", "{} AS symbol_name", "{} AS code_snippet",
               "{} AS fields", "{} AS original", "ordinal", "pos")

    def rows(df: DataFrame, *values: str) -> DataFrame:
        given = iter(values)
        return df.selectExpr(*[c.format(next(given)) if "{}" in c else c for c in columns])

    no_list, no_text = "CAST(NULL AS array<string>)", "CAST(NULL AS string)"
    return (rows(structs(u), "struct", "name", "code", "fields", no_text)
            .unionByName(rows(typedefs(u), "typedef", "alias", "code", no_list, "original"))
            .unionByName(rows(globals_(u), "global", "name", "type", no_list, no_text)))


def file_info(files: DataFrame, functions: DataFrame, symbols: DataFrame, call_rows: DataFrame) -> DataFrame:
    """Number of records of each kind per file (E10), zero where a file has none."""
    def part(rows: DataFrame, kind: Column) -> DataFrame:
        return rows.select("path", kind.alias("kind"))

    rows = (part(functions, F.when(F.col("is_prototype"), "prototypes").otherwise("definitions"))
            .unionByName(part(symbols, F.concat("symbol_type", F.lit("s"))))
            .unionByName(part(call_rows, F.lit("calls"))).unionByName(part(files, F.lit("file"))))
    kinds = ["definitions", "prototypes", "structs", "typedefs", "globals", "calls"]
    return rows.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias("n_" + k) for k in kinds])


def file_quality(files: DataFrame) -> DataFrame:
    """Files whose braces do not balance, where units may be cut wrongly."""
    return parsed_files(files).select("path", "n_units", "final_depth").where("final_depth <> 0")


__all__ = ["units", "definitions", "prototypes", "functions", "structs", "typedefs", "globals_",
           "calls", "file_symbols", "file_quality", "function_key"]

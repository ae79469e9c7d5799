"""Cases whose answer is known from the rows they are made of: files rendered from the star schema by one SQL text that both
engines run, judged by the operators, and the same answers in SQL without reading any text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.llm import credentials, handwritten, syntax
from loamgraph.session import table

NL = "' || chr(10) || '"


def _files(key: str, source: str, ext: str, text: str) -> str:
    return f"select cast({key} as bigint) as file_id, 'z' as repo, 'repositories/z/f' || {key} || {ext} as file_path, 'f' || {key} || {ext} as rel_path, {ext} as ext, {text} as text from {source}"


# files that parse and files that don't
_P1_EXT = "case p_partkey % 7 when 0 then '.json' when 1 then '.json' when 2 then '.js' when 3 then '.js' when 4 then '.py' when 5 then '.tsx' else '.ts' end"
_P1 = _files(
    "p_partkey", "{part}", _P1_EXT,
    f"""case p_partkey % 7 when 0 then '{{{{"part": ' || p_partkey || ', "sizes": [1, ' || p_size || ']}}}}' when 1 then '{{{{"part": ' || p_partkey || ', "sizes": [1, ' when 2 then 'const part' || p_partkey || ' = (a, b = ' || p_size || ') => {{{{ return a + b }}}};'
 when 3 then 'const part' || p_partkey || ' = ;' when 4 then 'def part' || p_partkey || '(size=' || p_size || '):{NL}    return size{NL}<<<<<<< ours{NL}' when 5 then 'const x = <Part size={{{{' || p_size || '}}}}>text</Part>;' else 'let part' || p_partkey || ': Array<number' end""".replace("{{{{", "{{").replace("}}}}", "}}"),
)


def p1_planted(spark, d):
    return syntax.verdicts(spark.sql(_P1, part=table(spark, d, "part"))).select("file_id", "language", "valid", "reason")


# credentials, and what only looks so; the text with the credential masked
_WORD = "'Qx' || substr(md5(cast(c_custkey as string)), 1, 12) || '!z'"


def _p3_text(word: str) -> str:
    return f"""'# settings of ' || c_custkey || '{NL}' || case c_custkey % 5 when 0 then 'db_password = "' || {word} || '"' when 1 then 'url = "postgres://app:' || {word} || '@db.internal/x"' when 2 then 'password = "${{{{DB_PASSWORD}}}}"'
 when 3 then 'checksum = "sha256:' || md5(cast(c_custkey as string)) || '"' else '# curl -u deploy:' || {word} || ' https://x' end || '{NL}limit = ' || c_custkey || '{NL}'"""


_P3 = _files("c_custkey", "{customer}", "'.py'", _p3_text(_WORD).replace("{{{{", "{{").replace("}}}}", "}}"))


def p3_planted(spark, d):
    f = spark.sql(_P3, customer=table(spark, d, "customer"))
    places = credentials.credentials(f).select("file_id", "line_no").distinct()
    return places.join(credentials.redacted(f).select("file_id", "text"), "file_id")


# hand-written files and others
_P6_EXT = "case p_partkey % 5 when 4 then '.js' else '.py' end"
_CODE = f"'def load_' || p_partkey || '(path, mode=\"r\"):{NL}    \"\"\"Reads part ' || p_partkey || '.\"\"\"{NL}    with open(path, mode) as handle:{NL}        lines = [line.strip() for line in handle]{NL}    if not lines:{NL}        raise ValueError(path){NL}    return sorted(set(lines), key=len)[: ' || p_size || ']{NL}'"
_P6 = _files(
    "p_partkey", "{part}", _P6_EXT,
    f"""case p_partkey % 5 when 0 then {_CODE} when 1 then '# Code generated by partc v' || p_size || '. DO NOT EDIT.{NL}' || {_CODE} when 2 then '# vendored: quill==1.2.' || p_size || '{NL}' || {_CODE}
 when 3 then 'TABLE_' || p_partkey || ' = [{NL}' || repeat(p_size || '12, 34567, 890, 1234,{NL}', 40) || ']{NL}' else repeat('var a' || p_size || '=function(b){{{{return b&&b.c?b.d(' || p_size || '):null}}}};', 20) end""",
)


def p6_planted(spark, d):
    packages = spark.createDataFrame([("quill", "1.2.3", "Open", "quill_src")], "package string, version string, licence string, home_repo string")
    return handwritten.classify(spark.sql(_P6, part=table(spark, d, "part")), packages).select("file_id", "kind")


QUERIES = {"p1_planted": p1_planted, "p3_planted": p3_planted, "p6_planted": p6_planted}
SQL = {
    "p1_planted": """select p_partkey as file_id, case p_partkey % 7 when 0 then 'json' when 1 then 'json' when 2 then 'javascript' when 3 then 'javascript' when 4 then 'python' when 5 then 'tsx' else 'typescript' end as language,
 p_partkey % 7 in (0, 2, 5) as valid, case p_partkey % 7 when 1 then 'truncated' when 3 then 'token' when 4 then 'conflict' when 6 then 'truncated' end as reason from part""",
    "p3_planted": f"select c_custkey as file_id, cast(2 as integer) as line_no, {_p3_text(f'repeat(chr(88), length({_WORD}))')} as text from customer where c_custkey % 5 in (0, 1, 4)".replace("{{{{", "{").replace("}}}}", "}"),
    "p6_planted": "select p_partkey as file_id, case p_partkey % 5 when 1 then 'generated' when 2 then 'vendored' when 3 then 'data' when 4 then 'minified' end as kind from part",
}

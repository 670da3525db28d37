"""Queries on training data: chats, splits, contamination, export and merge, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions.sql import F as X
from alertloom import schemas as S
from alertloom.functions.sql import Sql, columns
from alertloom.functions.stage import once
from alertloom.functions.text import dumps, loose_digest
from alertloom.operators import label, metrics, training
from alertloom.plans import bindings as bind
from alertloom.session import scratch
from alertloom.sources import files
from alertloom.streaming import jobs

_HEAD = "Normalize this {} security alert to OCSF Detection Finding format.\n\n"


def _chats(s, d, dealt=False):
    """Built examples, one per event; some answers are broken on purpose."""
    rows = (bind.dealt if dealt else bind.view)(s, d, bind.EVENT).selectExpr(
        "id", "CASE WHEN id % 9 = 0 THEN 'palo-alto' ELSE ty END AS source", "props",
        "CASE id % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"class_uid\":1}' ELSE concat('{\"class_uid\":2004,\"n\":', k, '}') END AS answer",
    )
    return rows.select("id", training.chat_example(F.col("source"), F.col("props"), F.col("answer")).alias("messages"))


def _conversations(s, d):
    """Conversations as messages.  Only those of three turns can be valid, so only they are gathered; the
    others, counted over all their turns, go on with their first role alone and are of the wrong length."""
    rows = bind.read_table(s, d, "conversations")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    short = rows.join(sizes.filter("n = 3"), "conv_id")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    whole = short.groupBy(F.col("conv_id").alias("id")).agg(F.transform(turns, message).alias("messages"))
    other = sizes.filter("n <> 3").select(F.col("conv_id").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content"))).alias("messages"))
    return whole.unionByName(other)


def _chat_validate(s, d):
    both = _chats(s, d).withColumn("kind", F.lit("built")).unionByName(
        _conversations(s, d).withColumn("kind", F.lit("real"))
    )
    return training.check_chat(both).select("kind", "id", F.coalesce("reject_reason", F.lit("ok")).alias("outcome"))


def _chat_files(s, d):
    """Chats written as lines, read back and checked; the good ones of each split, and the rejected lines with their reasons."""
    root = scratch(s, "chats")
    files.write_chat(_chats(s, d, dealt=True), f"{root}/in", compression="gzip")
    bind.view(s, d, bind.EVENT).filter("id % 40 = 0").selectExpr("concat('not json ', id) AS value").write.text(f"{root}/broken")
    checked = training.check_chat(files.read_chat(s, f"{root}/*"))
    good = checked.filter("reject_reason IS NULL").withColumn("split", F.when(F.contains(training.user_message(), F.lit("purchase")), "val").otherwise("train"))
    files.write_splits(good, f"{root}-split", compression="gzip")
    files.write_rejected(checked.filter("reject_reason IS NOT NULL"), f"{root}-rejected", compression="gzip")
    sizes = [files.read_split(s, f"{root}-split", name).select(F.lit(name).alias("kind"), F.sha2(F.get("messages", F.lit(2))["content"], 256).alias("digest")) for name in ("train", "val")]
    strict = files.read_chat_strict(s, f"{root}/in").select(F.lit("strict").alias("kind"), F.sha2(training.user_message(), 256).alias("digest"))
    reasons = s.read.text(f"{root}-rejected").select(F.get_json_object("value", "$._reject_reason").alias("kind"), F.sha2(F.coalesce(F.get_json_object("value", "$._raw"), F.lit("")), 256).alias("digest"))
    return sizes[0].unionByName(sizes[1]).unionByName(strict).unionByName(reasons).groupBy("kind", "digest").agg(F.count("*").alias("n"))


def _documents(s, d):
    return bind.read_table(s, d, "documents").select("doc_id", F.col("source").alias("vendor"), "text")


def _split(s, d, by_text: bool = True):
    key = F.col("text") if by_text else F.col("doc_id").cast("string")
    return training.assign_split(_documents(s, d), "vendor", F.sha2(key, 256), "doc_id")


def _digest_files(s, d):
    """Digests of test inputs as lines."""
    root = scratch(s, "digests")
    files.write_digests(training.test_ids(_split(s, d), "text"), root)
    return s.read.text(root).select(F.col("value").alias("digest"))


def _completion(s, d):
    """The marker is put into every document text once, twice or never."""
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 > 0, "<|assistant|>\n").otherwise(""), F.lit("A"),
                    F.when(F.col("doc_id") % 3 == 2, "<|assistant|>\n").otherwise(""), F.lit("B"))
    p, c = training.prompt_completion(text)
    return _documents(s, d).select("doc_id", F.length(p).cast("bigint").alias("n_prompt"), c.alias("_c")).select(
        "doc_id", "n_prompt", F.sha2("_c", 256).alias("completion"))


def _few_shot(s, d):
    rows = bind.view(s, d, bind.EVENT)
    example = F.struct(F.lit("log").alias("raw_log"), F.lit("{}").alias("ocsf"), F.col("ty").alias("source"))
    m = training.prompt(F.col("ty"), F.col("props"), F.array(example, example))
    return rows.select("id", m.alias("m")).select(
        "id", F.size("m").cast("bigint").alias("n_messages"),
        F.concat_ws(",", F.transform("m", lambda x: x["role"])).alias("roles"),
        F.sha2(F.get("m", F.lit(5))["content"], 256).alias("last"))


def _export(s, d):
    return training.exportable(bind.view(s, d, bind.REVIEW), bind.view(s, d, bind.RAW_LOG))


def _export_chats(s, d):
    """An export run over all reviews, and a second one that finds nothing new: the lines, by their place, beside the marks, by id."""
    root = scratch(s, "export")
    reviews, raw = bind.view(s, d, bind.REVIEW), bind.view(s, d, bind.RAW_LOG)
    jobs.export_chats(reviews, raw, root, 0)
    jobs.export_chats(reviews, raw, root, 1)
    lines = files.read_lines_in_order(s, f"{root}/chats/*")
    numbered = label.with_ordinal(lines, "place", f"{root}/numbered")
    marks = label.with_ordinal(jobs.read(s, root, "exported").select("id"), "id", f"{root}/marked")
    chat = numbered.select("ordinal", F.from_json("line", S.CHAT)["messages"].alias("messages"))
    return chat.join(marks, "ordinal").select("id", training.user_message().alias("user_text"), F.get("messages", F.lit(2))["content"].alias("answer"))


_FORM = """concat('{"id":', id, ',"ty":"', ty, '","l":[1,[],{"n":null}],"e":"é"}')"""


def _json_forms(s, d):
    """One JSON text written over lines, in one line with other letters escaped, and compactly."""
    made = once(bind.dealt(s, d, bind.EVENT), ["id"], j=Sql(_FORM))
    forms = {"lines": dumps(X.col("j"), indent=2), "one_ascii": dumps(X.col("j"), ascii_only=True), "compact": dumps(X.col("j"), compact=True)}
    return made.select("id", *columns(**forms))


def _merge_sides(s, d):
    """Documents as originals; the French ones, re-spaced, are the corrections."""
    rows = bind.read_table(s, d, "documents")
    side = lambda df: df.select("text", F.col("doc_id").alias("ord"))
    spaced = F.concat(F.lit("  "), F.regexp_replace("text", " ", "  "), F.lit(" "))
    return side(rows), side(rows.filter(F.col("lang") == "fr")).withColumn("text", spaced)


def _merge(s, d):
    merged = training.merge(*_merge_sides(s, d), "text", "ord")
    return merged.select("ord", "is_correction", F.col("position.ord").alias("first_ord"))


def _parse_rate(s, d):
    rows = bind.view(s, d, bind.METRIC)
    out = metrics.parse_rate(rows, F.col("confidence").isNotNull(), F.col("confidence"))
    return out.withColumns({c: F.round(c, 6) for c in ("parse_rate", "avg_confidence")})


def _tokens(s, d):
    chats = training.check_chat(_chats(s, d)).filter(F.col("reject_reason").isNull())
    return training.token_stats(chats).select(*[F.col(c).cast("bigint").alias(c) for c in training.token_stats(chats).columns])


QUERIES = {
    "chat_build": lambda s, d: _chats(s, d).select(
        "id", F.sha2(F.get("messages", F.lit(0))["content"], 256).alias("system"),
        training.user_message().alias("user_text"), F.get("messages", F.lit(2))["content"].alias("answer")),
    "chat_validate": _chat_validate,
    "chat_vendor": lambda s, d: _chats(s, d).select("id", training.vendor_of(training.user_message()).alias("vendor")),
    "chat_vendors_distinct": lambda s, d: _chats(s, d).select(training.vendor_of(training.user_message()).alias("vendor")).distinct(),
    "chat_token_stats": _tokens,
    "chat_preview": lambda s, d: training.preview(_chats(s, d), "id").select(
        F.get("messages", F.lit(0))["content"].alias("system"), training.user_message().alias("user_text")),
    "prompt_completion": _completion,
    "few_shot_prompt": _few_shot,
    "message_digests": lambda s, d: _documents(s, d).select(
        "doc_id", F.sha2("text", 256).alias("exact"), loose_digest(X.col("text")).column().alias("loose")),
    "split_assign": lambda s, d: _split(s, d).select("doc_id", "vendor", "split"),
    "split_counts": lambda s, d: training.split_counts(_split(s, d), "vendor"),
    "split_sizes": lambda s, d: training.split_sizes(_split(s, d)),
    "split_missing_vendors": lambda s, d: training.missing_vendors(
        training.assign_split(bind.view(s, d, bind.EVENT).select("id", F.concat_ws("-", "u", "k").alias("vendor")),
                              "vendor", F.sha2(F.col("id").cast("string"), 256), "id"), "vendor"),
    "split_contamination": lambda s, d: training.contamination(_split(s, d, by_text=False), "text"),
    "split_test_ids": lambda s, d: training.test_ids(_split(s, d), "text"),
    "export_corrections": lambda s, d: _export(s, d).select("id", "source", "raw_content", F.coalesce("skip_reason", F.lit("ok")).alias("outcome")),
    "export_summary": lambda s, d: training.export_summary(_export(s, d)),
    "chat_files": _chat_files,
    "digest_files": _digest_files,
    "export_chats": _export_chats,
    "json_forms": _json_forms,
    "merge_corrections": _merge,
    "merge_summary": lambda s, d: training.merge_summary(*_merge_sides(s, d), "text"),
    "parse_rate": _parse_rate,
}

_E, _V, _R, _M = bind.duck("e", bind.EVENT), bind.duck("v", bind.REVIEW), bind.duck("r", bind.RAW_LOG), bind.duck("m", bind.METRIC)
_SRC = "CASE WHEN id % 9 = 0 THEN 'palo-alto' ELSE ty END"
_ANSWER = """CASE id % 5 WHEN 0 THEN '{bad' WHEN 1 THEN '{"class_uid":1}' ELSE concat('{"class_uid":2004,"n":', cast(k AS varchar), '}') END"""
_PROMPT = "concat('Normalize this ', {}, ' security alert to OCSF Detection Finding format.', chr(10), chr(10), {})"
_COMPACT = "concat('{\"k\":', cast(k AS varchar), '}')"
_USER = _PROMPT.format(_SRC, _COMPACT)
_SYSTEM = "'" + training.SYSTEM_PROMPT.replace("'", "''") + "'"


def _split_sql(key: str, rows: str = "SELECT doc_id AS id, source AS vendor, text FROM documents") -> str:
    return f"""d AS ({rows}), p AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY sha256({key}), id) - 1 AS i,
        count(*) OVER (PARTITION BY vendor) AS n FROM d),
        s AS (SELECT *, CASE WHEN i * 10 < n * 8 THEN 'train' WHEN i * 10 < n * 9 THEN 'val' ELSE 'test' END AS split FROM p)"""


_BLANK = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+'"
_LOOSE = f"sha256(trim(regexp_replace(text, {_BLANK}, ' ', 'g')))"
_SIDES = f"""o AS (SELECT {_LOOSE} AS dg, doc_id AS ord, 0 AS c, lang FROM documents),
    x AS (SELECT dg, ord, c FROM o UNION ALL SELECT dg, ord, 1 FROM o WHERE lang = 'fr')"""

ORACLES = {
    "chat_build": f"WITH {_E} SELECT id, sha256({_SYSTEM}) AS system, {_USER} AS user_text, {_ANSWER} AS answer FROM e",
    "chat_validate": f"""WITH {_E} SELECT 'built' AS kind, id, CASE id % 5 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'class_uid' ELSE 'ok' END AS outcome FROM e
        UNION ALL SELECT 'real', conv_id, CASE WHEN count(*) <> 3 THEN 'message_count'
        WHEN string_agg(role, ',' ORDER BY turn) <> 'system,user,assistant' THEN 'roles' ELSE 'bad_json' END FROM conversations GROUP BY conv_id""",
    "chat_vendor": f"WITH {_E} SELECT id, CASE WHEN id % 9 = 0 THEN 'unknown' ELSE ty END AS vendor FROM e",
    "chat_vendors_distinct": f"WITH {_E} SELECT DISTINCT CASE WHEN id % 9 = 0 THEN 'unknown' ELSE ty END AS vendor FROM e",
    "chat_token_stats": f"""WITH {_E}, t AS (SELECT length({_USER}) // 4 AS u, length({_ANSWER}) // 4 AS a, length({_SYSTEM}) // 4 AS s FROM e WHERE id % 5 > 1)
        SELECT cast(max(s) AS bigint) AS system_tokens, cast(floor(avg(u)) AS bigint) AS user_avg, max(u) AS user_max, cast(floor(avg(a)) AS bigint) AS assistant_avg,
        max(a) AS assistant_max, cast(floor(avg(u + a + s)) AS bigint) AS total_avg, max(u + a + s) AS total_max FROM t""",
    "chat_preview": f"WITH {_E} SELECT left({_SYSTEM}, 200) AS system, left({_USER}, 200) AS user_text FROM e ORDER BY id LIMIT 1",
    "prompt_completion": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN length(text) + 14 ELSE 0 END AS n_prompt,
        sha256(CASE doc_id % 3 WHEN 0 THEN concat(text, 'AB') WHEN 1 THEN 'AB' ELSE concat('A<|assistant|>', chr(10), 'B') END) AS completion FROM documents""",
    "few_shot_prompt": f"""WITH {_E} SELECT id, 6 AS n_messages, 'system,user,assistant,user,assistant,user' AS roles,
        sha256({_PROMPT.format('ty', 'props')}) AS last FROM e""",
    "message_digests": f"SELECT doc_id, sha256(text) AS exact, {_LOOSE} AS loose FROM documents",
    "split_assign": f"WITH {_split_sql('text')} SELECT id AS doc_id, vendor, split FROM s",
    "split_counts": f"WITH {_split_sql('text')} SELECT split, vendor, count(*) AS count FROM s GROUP BY split, vendor",
    "split_sizes": f"WITH {_split_sql('text')} SELECT split, count(*) AS count FROM s GROUP BY split",
    "split_missing_vendors": f"""WITH {_E}, {_split_sql('cast(id AS varchar)', "SELECT id, concat(cast(u AS varchar), '-', cast(k AS varchar)) AS vendor FROM e")}
        SELECT a.split, b.vendor FROM (SELECT 'train' AS split UNION ALL SELECT 'val' UNION ALL SELECT 'test') a, (SELECT DISTINCT vendor FROM s) b
        WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.split = a.split AND s.vendor = b.vendor)""",
    "split_contamination": f"""WITH {_split_sql('cast(id AS varchar)')} SELECT DISTINCT sha256(text) AS digest FROM s WHERE split = 'test'
        AND sha256(text) IN (SELECT sha256(text) FROM s WHERE split = 'train')""",
    "split_test_ids": f"WITH {_split_sql('text')} SELECT sha256(text) AS digest FROM s WHERE split = 'test'",
    "export_corrections": f"""WITH {_V}, {_R} SELECT v.id, v.source, r.raw_content, CASE WHEN v.id % 7 = 0 THEN 'not_object' WHEN v.id % 11 = 0 THEN 'bad_json'
        WHEN v.id % 13 = 0 THEN 'class_uid' ELSE 'ok' END AS outcome FROM v JOIN r ON v.raw_log_id = r.id
        WHERE v.reviewed_at IS NOT NULL AND v.corrected IS NOT NULL AND NOT v.exported_for_training""",
    "chat_files": f"""WITH {_E}, c AS (SELECT id, ty, id % 5 AS r, {_USER} AS u, {_ANSWER} AS a, {_SRC} AS src FROM e), x AS (
        SELECT CASE WHEN contains(u, 'purchase') THEN 'val' ELSE 'train' END AS kind, sha256(a) AS digest FROM c WHERE r > 1 UNION ALL SELECT 'strict', sha256(u) FROM c
        UNION ALL SELECT CASE r WHEN 0 THEN 'bad_json' ELSE 'class_uid' END, sha256('') FROM c WHERE r < 2
        UNION ALL SELECT 'bad_line', sha256(concat('not json ', cast(id AS varchar))) FROM c WHERE id % 40 = 0) SELECT kind, digest, count(*) AS n FROM x GROUP BY ALL""",
    "digest_files": f"WITH {_split_sql('text')} SELECT sha256(text) AS digest FROM s WHERE split = 'test'",
    "export_chats": f"""WITH {_V}, {_R} SELECT v.id, {_PROMPT.format("v.source", "replace(r.raw_content, ': ', ':')")} AS user_text,
        concat('{{"class_uid":2004,"n":', cast(v.id AS varchar), '}}') AS answer FROM v JOIN r ON v.raw_log_id = r.id
        WHERE v.reviewed_at IS NOT NULL AND v.corrected IS NOT NULL AND NOT v.exported_for_training AND v.id % 7 <> 0 AND v.id % 11 <> 0 AND v.id % 13 <> 0""",
    "json_forms": f"""WITH {_E}, t AS (SELECT id, cast(id AS varchar) AS i, ty FROM e) SELECT id,
        concat_ws(chr(10), '{{', concat('  "id": ', i, ','), concat('  "ty": "', ty, '",'), '  "l": [', '    1,', '    [],', '    {{', '      "n": null', '    }}', '  ],', '  "e": "é"', '}}') AS lines,
        concat('{{"id": ', i, ', "ty": "', ty, '", "l": [1, [], {{"n": null}}], "e": "', chr(92), 'u00e9"}}') AS one_ascii,
        concat('{{"id":', i, ',"ty":"', ty, '","l":[1,[],{{"n":null}}],"e":"é"}}') AS compact FROM t""",
    "export_summary": f"""WITH {_V}, {_R} SELECT count(*) AS fetched, sum(CASE WHEN v.id % 7 = 0 OR v.id % 11 = 0 OR v.id % 13 = 0 THEN 0 ELSE 1 END) AS converted,
        sum(CASE WHEN v.id % 7 = 0 OR v.id % 11 = 0 OR v.id % 13 = 0 THEN 1 ELSE 0 END) AS skipped FROM v JOIN r ON v.raw_log_id = r.id
        WHERE v.reviewed_at IS NOT NULL AND v.corrected IS NOT NULL AND NOT v.exported_for_training""",
    "merge_corrections": f"""WITH {_SIDES} SELECT ord, c = 1 AS is_correction, first_ord FROM (SELECT *, row_number() OVER (PARTITION BY dg ORDER BY c DESC, ord DESC) AS rn,
        first_value(ord) OVER (PARTITION BY dg ORDER BY c, ord) AS first_ord FROM x) z WHERE rn = 1""",
    "merge_summary": f"""WITH {_SIDES}, g AS (SELECT dg, sum(1 - c) AS o, sum(c) AS n FROM x GROUP BY dg)
        SELECT cast(sum(o) AS bigint) AS originals, cast(sum(n) AS bigint) AS corrections,
        cast(sum(n) - sum(CASE WHEN o = 0 THEN 1 ELSE 0 END) AS bigint) AS replaced,
        cast(sum(CASE WHEN o = 0 THEN 1 ELSE 0 END) AS bigint) AS added, count(*) AS total_out FROM g""",
    "parse_rate": f"""WITH {_M} SELECT count(*) AS total, count(confidence) AS parsed, round(100.0 * count(confidence) / count(*), 6) AS parse_rate,
        round(avg(confidence), 6) AS avg_confidence FROM m""",
}

"""Training data: chat examples, validity, splits, contamination, export and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom import schemas as S
from alertloom.functions.sql import F as X
from alertloom.functions.text import loose_digest

SPLITS = ("train", "val", "test")
ASSISTANT_MARKER = "<|assistant|>\n"
VENDOR_PATTERN = r"(?U)Normalize this (\w+) security alert"

# Fixed value: the system prompt; its wording, blanks and line ends are part of every example.
SYSTEM_PROMPT = """You are a security log normalizer. You convert raw vendor security alerts into OCSF v1.1.0 Detection Finding (class_uid: 2004) format.

Rules:
- Output ONLY valid JSON. No markdown, no explanation, no preamble.
- Map all SOC-useful fields. Sparse output is wrong.
- Process, network, actor, email evidence goes inside evidences[].
- MITRE ATT&CK goes inside finding_info.attacks[].
- User info goes in device.owner or evidences[].actor.user.
- Never put process, src_endpoint, dst_endpoint, attacks, or user at the top level.
- Place vendor-specific fields that have no OCSF equivalent in an unmapped object. Never invent OCSF field names. 
- Include observables[] with key IOCs (IPs, hashes, domains, emails, usernames).
- The severity_id enum values (0=Unknown through 6=Fatal, and 99=Other)            
- The type_uid formula: type_uid = class_uid * 100 + activity_id
- Omit fields with no value. No nulls, no empty strings, no placeholders.
            """


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(source: Column, raw_log: Column) -> Column:
    head = F.concat(
        F.lit("Normalize this "), source, F.lit(" security alert to OCSF Detection Finding format.\n\n")
    )
    return F.concat(head, raw_log)


def prompt(source: Column, raw_log: Column, examples: Column | None = None) -> Column:
    """System message, optional user/assistant pairs of ``examples``, user message.

    ``examples``: array of (raw_log, ocsf, source).
    """
    system = F.array(_message("system", F.lit(SYSTEM_PROMPT)))
    user = F.array(_message("user", user_prompt(source, raw_log)))
    if examples is None:
        return F.concat(system, user)
    pairs = F.flatten(
        F.transform(
            examples,
            lambda e: F.array(
                _message("user", user_prompt(e["source"], e["raw_log"])), _message("assistant", e["ocsf"])
            ),
        )
    )
    return F.concat(system, pairs, user)


def canonical(json_text: Column) -> Column:
    """Compact JSON with sorted keys, so that differently indented copies become equal; other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text)


def chat_example(source: Column, raw_log: Column, finding: Column) -> Column:
    """Three-message example; originals and corrections share this form so their digests meet."""
    return F.concat(
        prompt(source, canonical(raw_log)), F.array(_message("assistant", finding))
    )


def check_chat(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds ``reject_reason``, the first failed check: bad_line (where the rows say so), message_count, roles, bad_json, class_uid."""
    m = F.col(messages)
    answer = F.try_parse_json(F.get(m, F.lit(2))["content"])
    class_uid = F.try_variant_get(answer, "$.class_uid", "double")
    # Only a JSON number equals 2004, not the text "2004".
    number = ~F.coalesce(F.schema_of_variant(F.try_variant_get(answer, "$.class_uid", "variant")) == "STRING", F.lit(False))
    bad_line = F.coalesce("bad_line", F.lit(False)) if "bad_line" in chats.columns else F.lit(False)
    reason = (
        F.when(bad_line, "bad_line")
        .when(m.isNull() | (F.size(m) != 3), "message_count")
        .when(
            F.transform(m, lambda x: F.coalesce(x["role"], F.lit("")))
            != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
            "roles",
        )
        .when(answer.isNull(), "bad_json")
        .when(~F.coalesce((class_uid == S.CLASS_UID) & number, F.lit(False)), "class_uid")
    )
    return chats.withColumn("reject_reason", reason)


def user_message(messages: str = "messages") -> Column:
    return F.get(F.col(messages), F.lit(1))["content"]


def vendor_of(message: Column) -> Column:
    """Vendor named in a user message, else "unknown"."""
    found = F.regexp_extract(message, VENDOR_PATTERN, 1)
    return F.when(found == "", "unknown").otherwise(found)


def token_stats(chats: DataFrame, messages: str = "messages") -> DataFrame:
    """Estimated tokens (characters // 4): fixed system part, floor-average and maximum of the rest."""
    m = F.col(messages)
    tokens = lambda i: F.floor(F.length(F.get(m, F.lit(i))["content"]) / 4)
    each = chats.select(tokens(1).alias("u"), tokens(2).alias("a"))
    system = len(SYSTEM_PROMPT) // 4
    return each.agg(
        F.lit(system).alias("system_tokens"),
        F.floor(F.avg("u")).alias("user_avg"),
        F.max("u").alias("user_max"),
        F.floor(F.avg("a")).alias("assistant_avg"),
        F.max("a").alias("assistant_max"),
        F.floor(F.avg(F.col("u") + F.col("a") + system)).alias("total_avg"),
        F.max(F.col("u") + F.col("a") + system).alias("total_max"),
    )


def prompt_completion(text: Column, marker: str = ASSISTANT_MARKER) -> tuple[Column, Column]:
    """(prompt, completion): cut after the first marker; without one all text is completion."""
    at = F.instr(text, marker)
    cut = at + len(marker) - 1
    return (
        F.when(at > 0, F.substr(text, F.lit(1), cut)).otherwise(""),
        F.when(at > 0, F.substr(text, cut + 1)).otherwise(text),
    )


def preview(chats: DataFrame, order: str, messages: str = "messages", width: int = 200) -> DataFrame:
    """First example, each message cut for display."""
    cut = F.transform(
        F.col(messages),
        lambda m: F.struct(m["role"].alias("role"), F.substring(m["content"], 1, width).alias("content")),
    )
    # The place is found by itself, so that only this example is made and kept.
    first = chats.select(F.col(order).alias("_first")).orderBy("_first").limit(1)
    return chats.join(F.broadcast(first), F.col(order).eqNullSafe(F.col("_first")), "left_semi").limit(1).select(cut.alias(messages))


def assign_split(
    df: DataFrame, vendor: str, digest: Column, tie: str, tie_rows: int = 1 << 20
) -> DataFrame:
    """80/10/10 per vendor, in order of (digest, tie); adds ``split``.  ``tie`` is a unique whole number.

    Neither a vendor nor a text with very many copies becomes one window group.
    Rows are ranked inside (vendor, digest, run of ``tie_rows`` tie numbers); the
    rows before such a run come from its count, summed inside slices of the
    digest range, and from the counts of the slices before.
    """
    run = [vendor, "_d", "_run"]
    marked = df.withColumn("_d", digest).withColumn("_run", F.floor(F.col(tie) / tie_rows))
    counts = (
        marked.groupBy(*run).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", F.substring("_d", 1, 3))
    )
    by_vendor = W.partitionBy(vendor)
    so_far = (W.unboundedPreceding, -1)
    none = F.lit(0)
    slices = counts.groupBy(vendor, "_slice").agg(F.sum("_n").alias("_m")).select(
        vendor,
        "_slice",
        F.coalesce(F.sum("_m").over(by_vendor.orderBy("_slice").rowsBetween(*so_far)), none).alias("_ahead"),
        F.sum("_m").over(by_vendor).alias("_total"),
    )
    in_slice = W.partitionBy(vendor, "_slice").orderBy("_d", "_run").rowsBetween(*so_far)
    before = (
        counts.withColumn("_inside", F.coalesce(F.sum("_n").over(in_slice), none))
        .join(slices, [vendor, "_slice"])
        .select(*run, (F.col("_ahead") + F.col("_inside")).alias("_before"), "_total")
    )
    place = F.row_number().over(W.partitionBy(*run).orderBy(tie))
    ranked = marked.withColumn("_place", place).join(before, run)
    position = F.col("_before") + F.col("_place") - 1
    # Whole numbers throughout: position * 10 < total * 8.
    split = (
        F.when(position * 10 < F.col("_total") * 8, "train")
        .when(position * 10 < F.col("_total") * 9, "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_d", "_run", "_place", "_before", "_total")


def split_counts(splits: DataFrame, vendor: str) -> DataFrame:
    return splits.groupBy("split", vendor).agg(F.count(F.lit(1)).alias("count"))


def split_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("count"))


def missing_vendors(splits: DataFrame, vendor: str) -> DataFrame:
    """(split, vendor) pairs without any row.  Works on the counts: one small row per vendor."""
    present = splits.groupBy(vendor).agg(F.collect_set("split").alias("_seen"))
    missing = F.array_except(F.array(*map(F.lit, SPLITS)), "_seen")
    return present.select(F.explode(missing).alias("split"), vendor)


def contamination(splits: DataFrame, message: str) -> DataFrame:
    """Digests of user messages that are both in train and in test."""
    digest = F.sha2(F.col(message), 256).alias("digest")
    # Distinct on both sides first: copies are combined before the shuffle.
    part = lambda s: splits.filter(F.col("split") == s).select(digest).distinct()
    return part("test").join(part("train"), "digest", "left_semi")


def test_ids(splits: DataFrame, message: str) -> DataFrame:
    """SHA-256 of each test input, for audit."""
    return splits.filter(F.col("split") == "test").select(F.sha2(F.col(message), 256).alias("digest"))


def check_correction(reviews: DataFrame, corrected: str = "corrected") -> DataFrame:
    """Adds ``skip_reason``: bad_json, not_object or class_uid."""
    v = F.try_parse_json(corrected)
    class_uid = F.try_variant_get(v, "$.class_uid", "variant")
    right = (F.try_variant_get(class_uid, "$", "double") == S.CLASS_UID) & (F.schema_of_variant(class_uid) != "STRING")
    reason = (
        F.when(v.isNull(), "bad_json")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object")
        .when(~F.coalesce(right, F.lit(False)), "class_uid")
    )
    return reviews.withColumn("skip_reason", reason)


def exportable(reviews: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Reviewed, corrected, not yet exported reviews with the raw log, checked.

    The filter is on plain columns and runs before the join.
    """
    due = reviews.filter(
        F.col("reviewed_at").isNotNull() & F.col("corrected").isNotNull() & ~F.col("exported_for_training")
    )
    raw = raw_logs.select(F.col("id").alias("raw_log_id"), "raw_content")
    return check_correction(due.join(raw, "raw_log_id"))


def export_chats(checked: DataFrame) -> DataFrame:
    """``id, messages``: the good ones of ``exportable`` as chat examples, in the form of the originals."""
    good = checked.filter(F.col("skip_reason").isNull())
    return good.select("id", chat_example(F.col("source"), F.col("raw_content"), canonical(F.col("corrected"))).alias("messages"))


def export_summary(checked: DataFrame) -> DataFrame:
    good = F.col("skip_reason").isNull().cast("long")
    return checked.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.coalesce(F.sum(good), F.lit(0)).alias("converted"),
        F.coalesce(F.sum(1 - good), F.lit(0)).alias("skipped"),
    )


def merge(originals: DataFrame, corrections: DataFrame, message: str, order: str, exact: bool = False) -> DataFrame:
    """Union with one row per message digest: the last correction, else the last original.

    Keeps the first position of the digest in ``position`` (originals before
    corrections); ``order`` is unique in either input.  Only digests and positions are
    aggregated, by hash and before the shuffle, so a message copied many times is no hot
    group; the texts come back for the winners alone.
    """
    digest = _digest(message, exact)
    tagged = originals.withColumn("is_correction", F.lit(False)).unionByName(
        corrections.withColumn("is_correction", F.lit(True))
    ).withColumn("digest", digest)
    own = F.col("is_correction")
    place = {"_last": F.max, "_first": F.min}
    spots = [f(F.when(own if c else ~own, F.col(order))).alias(f"{n}_{c}") for n, f in place.items() for c in (0, 1)]
    best = tagged.groupBy(F.col("digest").alias("_digest")).agg(*spots)
    chosen = best.select(
        "_digest", F.col("_last_1").isNotNull().alias("_own"), F.coalesce("_last_1", "_last_0").alias("_order"),
        F.struct(F.col("_first_0").isNull().alias("is_correction"), F.coalesce("_first_0", "_first_1").alias(order)).alias("position"),
    )
    hit = (F.col("digest") == F.col("_digest")) & (own == F.col("_own")) & (F.col(order) == F.col("_order"))
    return tagged.join(chosen, hit).select("digest", *originals.columns, "is_correction", "position")


def _digest(message: str, exact: bool) -> Column:
    return F.sha2(F.col(message), 256) if exact else loose_digest(X.col(message)).column()


def merge_summary(originals: DataFrame, corrections: DataFrame, message: str, exact: bool = False) -> DataFrame:
    """Counts of the merge: a correction replaces when its digest was seen before it."""
    digest = _digest(message, exact)
    tagged = originals.select(digest.alias("d"), F.lit(0).alias("c")).unionAll(
        corrections.select(digest.alias("d"), F.lit(1).alias("c"))
    )
    per = tagged.groupBy("d").agg(F.sum(1 - F.col("c")).alias("o"), F.sum("c").alias("n"))
    added = F.when((F.col("o") == 0) & (F.col("n") > 0), 1).otherwise(0)
    return per.agg(
        F.sum("o").alias("originals"),
        F.sum("n").alias("corrections"),
        (F.sum("n") - F.sum(added)).alias("replaced"),
        F.sum(added).alias("added"),
        F.count(F.lit(1)).alias("total_out"),
    )

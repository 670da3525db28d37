"""Scalar rules shared by the mappers: severities, statuses, times, hashes, observables."""

from __future__ import annotations

from itertools import chain


from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql
from alertloom.functions.text import strip

# --- fixed values -----------------------------------------------------------

SEVERITY_LABELS = {
    0: "Unknown",
    1: "Informational",
    2: "Low",
    3: "Medium",
    4: "High",
    5: "Critical",
    99: "Other",
}
TEXT_SEVERITIES = {
    "informational": 1,
    "info": 1,
    "low": 2,
    "medium": 3,
    "high": 4,
    "critical": 5,
}
ANALYST_SEVERITIES = {
    "low": 2,
    "medium": 3,
    "high": 4,
    "critical": 5,
    "informational": 1,
}
STATUS_LABELS = {1: "New", 2: "In Progress", 3: "Suppressed", 4: "Closed"}
CROWDSTRIKE_STATUSES = {
    "new": 1,
    "in_progress": 2,
    "true_positive": 4,
    "closed": 4,
    "false_positive": 4,
}
SPLUNK_STATUSES = {
    "new": 1,
    "inprogress": 2,
    "in progress": 2,
    "open": 2,
    "closed": 4,
    "resolved": 4,
    "suppressed": 3,
}
SPLUNK_STATUS_CODES = {"0": 1, "1": 1, "2": 2, "3": 2, "4": 4, "5": 4, "6": 4, "7": 3}
DEFENDER_STATUSES = {"new": 1, "inprogress": 2, "in_progress": 2, "resolved": 4, "redirected": 4}
LOGRHYTHM_STATUS_CODES = {0: 1, 1: 2, 2: 2, 3: 4, 4: 4, 5: 4, 6: 4, 7: 3, 8: 1}
LOGRHYTHM_STATUS_NAMES = {
    "new": 1,
    "working": 2,
    "escalated": 2,
    "closed": 4,
    "suppressed": 3,
    "pending": 1,
}
SENTINEL_STATUSES = {
    "new": 1,
    "active": 2,
    "open": 2,
    "inprogress": 2,
    "resolved": 4,
    "closed": 4,
}
OS_LABELS = {100: "Windows", 200: "macOS", 300: "Linux", 400: "Android", 500: "iOS"}
CROWDSTRIKE_OS = {
    "windows": 100,
    "macos": 200,
    "mac os x": 200,
    "linux": 300,
    "android": 400,
    "ios": 500,
}
PALOALTO_OS = {
    "windows": 100,
    "macos": 200,
    "mac": 200,
    "linux": 300,
    "android": 400,
    "ios": 500,
}
EXPEL_TACTICS = {
    "DELIVERY": "Initial Access",
    "EXPLOITATION": "Execution",
    "INSTALLATION": "Persistence",
    "C2": "Command and Control",
    "COMMAND_CONTROL": "Command and Control",
    "ACTIONS_ON_OBJECTIVES": "Impact",
    "RECONNAISSANCE": "Reconnaissance",
}
IOC_FIELDS = {
    "domain": "evidences[].dst_endpoint.domain",
    "ip_address": "evidences[].dst_endpoint.ip",
    "sha256": "evidences[].process.file.hashes.SHA-256",
    "md5": "evidences[].process.file.hashes.MD5",
    "url": "evidences[].dst_endpoint.url",
    "hostname": "device.hostname",
}
IOC_TYPES = {
    "domain": "Domain",
    "ip_address": "IP Address",
    "sha256": "Hash",
    "md5": "Hash",
    "url": "URL",
    "hostname": "Hostname",
}
HASH_ALGORITHMS = {"MD5": 1, "SHA-1": 2, "SHA-256": 3, "SHA-512": 4}
OBSERVABLE_TYPES = {
    "Hostname": 1,
    "IP Address": 2,
    "MAC Address": 3,
    "Email Address": 4,
    "URL": 5,
    "File Name": 7,
    "Hash": 8,
    "Process Name": 9,
    "Resource UID": 10,
    "Endpoint": 20,
    "Domain": 28,
}
# The model schema's own numbering of the same names, selectable in ``observable``.
MODEL_OBSERVABLE_TYPES = {
    "Hostname": 1,
    "IP Address": 2,
    "MAC Address": 3,
    "User Name": 4,
    "Email Address": 5,
    "URL": 6,
    "File Name": 7,
    "Hash": 8,
    "Process Name": 9,
    "Resource UID": 10,
    "Endpoint": 20,
}
ZERO_GUID = "00000000-0000-0000-0000-000000000000"
EPOCH_MILLIS_FROM = 1_000_000_000_000
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Written dates read besides ISO 8601; anything else takes the default time.
OTHER_DATE_PATTERNS = (
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy",
    "d MMM yyyy HH:mm:ss",
    "MMM d, yyyy HH:mm:ss",
)


# --- lookups ----------------------------------------------------------------


def lookup(table: dict, key: Sql) -> Sql:
    """Value of a small fixed table, NULL for an unknown or NULL key."""
    literal = F.map(*chain.from_iterable(table.items()))
    return F.try_element_at(literal, key)


def severity_label(severity_id: Sql) -> Sql:
    return F.coalesce(lookup(SEVERITY_LABELS, severity_id), F.lit("Unknown"))


def status_label(status_id: Sql) -> Sql:
    return lookup(STATUS_LABELS, status_id)


def crowdstrike_severity(score: Sql) -> Sql:
    """0-100 score, already cast to an integer, to a severity id."""
    return (
        F.when(score.isNull(), 0)
        .when(score <= 19, 1)
        .when(score <= 39, 2)
        .when(score <= 59, 3)
        .when(score <= 79, 4)
        .otherwise(5)
    )


def logrhythm_severity(score: Sql) -> Sql:
    return F.when(score.isNull(), 0).when(score <= 39, 2).when(score <= 64, 3).otherwise(4)


def text_severity(word: Sql) -> Sql:
    return F.coalesce(lookup(TEXT_SEVERITIES, F.lower(strip(word))), F.lit(0))


# --- time -------------------------------------------------------------------


def time_text(v: Sql, *keys: str) -> Sql:
    """Time value as stripped text; ``$numberLong`` / ``$date`` wrappers are opened."""
    whole = strip(V.truthy(v, *keys))
    wrapped = Sql(V.get(v, *keys).text)
    opened = F.coalesce(
        V.truthy(wrapped, "$numberLong"),
        V.truthy(wrapped, "$date", "$numberLong"),
        V.truthy(wrapped, "$date"),
    )
    return F.when(whole.startswith("{"), F.coalesce(opened, whole)).otherwise(whole)


def first_time_text(v: Sql, *names: str) -> Sql:
    return F.coalesce(*[time_text(v, n) for n in names])


def parse_time(value: Sql) -> Sql:
    """UTC instant of a stripped time text, NULL when it cannot be read.

    Numbers are epoch seconds, or milliseconds above 10^12.  A text without a
    zone counts as UTC whatever the session zone is.
    """
    t = value
    number = F.when(
        t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")
    )
    seconds = F.when(number > EPOCH_MILLIS_FROM, number / 1000.0).otherwise(number)
    # Years 1 to 9999.
    in_range = seconds.between(-62135596800, 253402300799)
    from_number = F.when(in_range, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))
    zoned = F.when(t.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(
        F.when(t.rlike(r":"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z")))
    )
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(zoned))
    others = [
        F.from_utc_timestamp(F.try_to_timestamp(t, F.lit(p)), F.current_timezone())
        for p in OTHER_DATE_PATTERNS
    ]
    return F.when(number.isNotNull(), from_number).otherwise(
        F.coalesce(iso, F.when(~t.rlike(r"^\d{4}-"), F.coalesce(*others)))
    )


def iso_utc(instant: Sql) -> Sql:
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), ISO_FORMAT)


def iso_time(value: Sql) -> Sql:
    """``yyyy-MM-ddTHH:mm:ssZ`` of a time text, NULL when it cannot be read."""
    return iso_utc(parse_time(value))


# --- small builders ---------------------------------------------------------


def hash_record(algorithm: str, value: Sql) -> Sql:
    """Hash struct; NULL for a blank value or one of zeros and dashes only."""
    v = strip(value)
    real = F.translate(v, "0-", "") != ""
    record = B.always(
        S.HASH,
        algorithm=F.lit(algorithm),
        algorithm_id=F.lit(HASH_ALGORITHMS.get(algorithm, 0)),
        value=v,
    )
    return Sql(F.when(real, record).text, tests=(real.text,))


def hash_value(value: Sql) -> Sql:
    """Stripped hash text, NULL where ``hash_record`` is NULL."""
    v = strip(value)
    return F.when(F.translate(v, "0-", "") != "", v)


def raw_observable(name: Sql | str, type_: Sql | str, value: Sql) -> Sql:
    """(name, type, value) before de-duplication; NULL when the value is empty."""
    some = value != ""
    raw = F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), value.alias("value"))
    return Sql(F.when(some, raw).text, tests=(some.text,))


def observables(raw: Sql, by_value_only: Sql, types: dict | None = None) -> Sql:
    """Finding observables from raw ones: first wins, values trimmed, blanks left out.

    ``raw`` should be a column: it is used several times.
    """
    key = lambda o: F.when(by_value_only, o["value"]).otherwise(
        F.concat_ws("\u0001", o["type"], o["value"])
    )
    kept = F.when(F.size(raw) > 1, B.first_per_key(raw, key)).otherwise(raw)
    shaped = F.transform(kept, lambda o: observable(o["name"], o["type"], o["value"], types))
    return B.nonempty_array(F.filter(shaped, lambda o: o.isNotNull()))


def observable(name: Sql, type_: Sql, value: Sql, types: dict | None = None) -> Sql:
    return F.when(
        strip(value) != "",
        B.always(
            S.OBSERVABLE,
            name=name,
            type=type_,
            type_id=F.coalesce(lookup(types or OBSERVABLE_TYPES, type_), F.lit(0)),
            value=strip(value),
        ),
    )


def mitre_uid(raw: Sql) -> Sql:
    """ID of "T1036 - Masquerading"; NULL when the text has no such head."""
    return B.some_text(F.regexp_extract(strip(raw), MITRE_ID_NAME, 1))


def mitre_name(raw: Sql) -> Sql:
    t = strip(raw)
    return B.some_text(
        F.coalesce(B.some_text(strip(F.regexp_extract(t, MITRE_ID_NAME, 2))), t)
    )


MITRE_ID_NAME = r"^([A-Z]{1,2}\d{4}(?:\.\d+)?)\s*-\s*(.+)$"
MITRE_IN_TITLE = r"MITRE-([A-Z]{2}\d{4})"


def mitre_ids_in_title(title: Sql) -> Sql:
    return B.nonempty_array(F.regexp_extract_all(title, F.lit(MITRE_IN_TITLE), F.lit(1)))


def looks_like_ip(t: Sql) -> Sql:
    """Dotted quad shape, or a colon and no trailing dot."""
    return t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (t.contains(":") & ~t.endswith("."))


def first_of_comma_list(t: Sql) -> Sql:
    return B.some_text(strip(F.split(t, ",")[0]))


def path_tail(t: Sql) -> Sql:
    """File name of a Windows or Unix path."""
    return B.some_text(F.element_at(F.split(t, r"[\\/]"), -1))

"""Columns from commit messages, statements and pictures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of references, trailers and automatic authors.
TICKET = r"[A-Z][A-Z0-9]{1,9}-[1-9][0-9]*"
RECORDS = {"CHG": "change", "CTASK": "change-task", "INC": "incident", "PRB": "problem", "RITM": "request-item", "REQ": "request"}
RECORD = r"\b((?:CHG|CTASK|INC|PRB|RITM|REQ)[0-9]{7})\b"
TRAILER = r"^[A-Za-z0-9][A-Za-z0-9-]*:[ \t]+\S.*$"
AGENT_NAME = r"(?i)(\[bot\]$|\bbot$)"
AGENT_ADDRESS = r"(?i)(^|[-_.+])bot@"
AGENT_KEYS = ("assisted-by", "generated-by", "ai-agent")
PERSON_KEYS = ("requested-by", "approved-by", "reviewed-by", "signed-off-by", "co-authored-by", "acked-by", "tested-by", *AGENT_KEYS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once for each row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trailers(lines: Column) -> Column:
    """The last paragraph's lines if a blank line stands before it and each of them is `Key: value`, else an empty array."""
    none = F.array().cast("array<string>")
    behind = lambda blank: F.when(blank >= 0, F.slice(lines, blank + 2, F.greatest(F.size(lines) - blank - 1, F.lit(0)))).otherwise(none)
    last = bound(F.array_max(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i).otherwise(-1))), behind)
    return bound(last, lambda part: F.when((F.size(part) > 0) & F.forall(part, lambda x: x.rlike(TRAILER)), part).otherwise(none))


def key_of(trailer: Column) -> Column:
    return F.lower(F.regexp_extract(trailer, r"^([^:]+):", 1))


def value_of(trailer: Column) -> Column:
    return F.rtrim(F.regexp_extract(trailer, r"^[^:]+:[ \t]+(\S.*)$", 1))


def values_of(block: Column, key: str) -> Column:
    """The values of trailers with a key, in order."""
    return F.transform(F.filter(block, lambda x: key_of(x) == key.lower()), value_of)


def person(value: Column) -> tuple[Column, Column]:
    """(name, email or null) of `Name <email>` or a bare name."""
    email = F.regexp_extract(value, r"<([^<>@\s]+@[^<>\s]+)>\s*$", 1)
    return F.when(email != "", F.trim(F.regexp_replace(value, r"<[^<>]+>\s*$", ""))).otherwise(F.trim(value)), F.when(email != "", email)


def person_struct(name: Column, email: Column) -> Column:
    return F.struct(name.alias("name"), email.alias("email"))


def people_of(block: Column, key: str) -> Column:
    """The people (structs of name and email) whom trailers with a key name, in order."""
    return F.transform(values_of(block, key), lambda v: person_struct(*person(v)))


def is_agent(name: Column, email: Column, addresses: tuple[str, ...] = ()) -> Column:
    """Whether a name or an address is a bot's; `addresses` are further ones that the team knows."""
    mail = F.lower(F.coalesce(email, F.lit("")))
    return F.trim(name).rlike(AGENT_NAME) | mail.rlike(AGENT_ADDRESS) | mail.isin([a.lower() for a in addresses])


def agents(block: Column) -> Column:
    """The trailers that name an automatic author: those of agent keys, and of person keys with a bot in them."""
    def named(x: Column) -> Column:
        name, email = person(value_of(x))
        return key_of(x).isin(*AGENT_KEYS) | (key_of(x).isin(*PERSON_KEYS) & is_agent(name, email))

    return F.filter(block, named)


def tickets(lines: Column, block: Column) -> Column:
    """(id, system, type, place) of each ticket that a message names, each id once, where it is first seen: trailers that name no person, then the other lines.

    Record numbers count wherever they stand. Keys of trackers count in trailer values, at the
    subject's beginning and in square brackets only, as names of standards have the same form.
    """
    kind = F.create_map(*[F.lit(x) for pair in RECORDS.items() for x in pair])
    make = lambda system, of, place: lambda i: F.struct(i.alias("id"), F.lit(system).alias("system"), of(i).alias("type"), place.alias("place"))
    records = lambda t, place: F.transform(F.regexp_extract_all(t, F.lit(RECORD), 1), make("records", lambda i: kind[F.regexp_extract(i, "^([A-Z]+)", 1)], place))
    keys = lambda found, place: F.transform(found, make("tracker", lambda i: F.lit("issue"), place))
    values = F.transform(F.filter(block, lambda x: ~key_of(x).isin(*PERSON_KEYS)), value_of)
    trailer = F.lit("trailer")
    first = F.flatten(F.transform(values, lambda v: F.concat(records(v, trailer), keys(F.regexp_extract_all(v, F.lit(rf"\b({TICKET})\b"), 1), trailer))))
    rest = F.slice(lines, F.lit(1), F.size(lines) - F.size(block))

    def of_line(text: Column, k: Column) -> Column:
        place = F.when(k == 0, "subject").otherwise("body")
        start = F.when(k == 0, F.regexp_extract(text, rf"^\[?({TICKET})\]?[:\s]", 1)).otherwise("")
        found = F.concat(F.filter(F.array(start), lambda x: x != ""), F.regexp_extract_all(text, F.lit(rf"\[({TICKET})\]"), 1))
        return F.concat(records(text, place), keys(found, place))

    return bound(F.concat(first, F.flatten(F.transform(rest, of_line))), lambda a: F.filter(a, lambda x, k: ~F.exists(F.slice(a, F.lit(1), k), lambda y: y["id"] == x["id"])))


def same_person(name_a: Column, email_a: Column, name_b: Column, email_b: Column) -> Column:
    """By email where both have one, else by name; case doesn't count. Not transitive."""
    return F.when(email_a.isNotNull() & email_b.isNotNull(), F.lower(email_a) == F.lower(email_b)).otherwise(F.lower(name_a) == F.lower(name_b))


#: Words that name a family of algorithms, tried in this order.
FAMILIES = (
    ("ML-?KEM", "ML-KEM"), ("RSA", "RSA"), ("(?:ECC|ECDSA|ECDH|EC-)", "EC"), ("DSA(?![A-Z0-9])", "DSA"), ("(?:DH|DIFFIE)", "DH"), ("SHA-?1(?![0-9])", "SHA-1"),
    ("SHA-?(?:2|224|256|384|512)(?![0-9])", "SHA-2"), ("MD5(?![A-Z0-9])", "MD5"), ("AES", "AES"), ("T?DES", "DES"),
)
#: Those that a quantum computer breaks.
BROKEN = ("RSA", "EC", "DSA", "DH")


def algorithm(text: Column) -> Column:
    """The first family that one of a text's words begins with, else unknown. A word begins behind anything but a letter or digit."""
    out = F.when(F.lit(False), "")
    for pattern, name in FAMILIES:
        out = out.when(F.upper(text).rlike(rf"(?<![A-Z0-9]){pattern}"), name)
    return out.otherwise("unknown")


def vulnerable(name: Column) -> Column:
    """Whether a quantum computer breaks the family; null where it is unknown."""
    return F.when(name == "unknown", F.lit(None).cast("boolean")).otherwise(name.isin(*BROKEN))


def key_bits(text: Column, family: Column) -> Column:
    """The first number in a text that is a key size of RSA, DSA or DH, null for other families."""
    sizes = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda x: x.cast("int")), lambda n: n.isin(1024, 2048, 3072, 4096, 8192))
    return F.when(family.isin("RSA", "DSA", "DH"), F.get(sizes, F.lit(0)))


def literals(text: Column) -> Column:
    """Quoted strings (either quote) and unsigned numbers in a text."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit("('[^']*'|\"[^\"]*\")"), 1), lambda x: F.regexp_replace(x, "^.|.$", ""))
    return F.array_union(quoted, F.regexp_extract_all(F.regexp_replace(text, "'[^']*'|\"[^\"]*\"", " "), F.lit(r"(?<![\w.])([0-9]+(?:\.[0-9]+)?)(?![\w.])"), 1))


def picture(pic: Column) -> dict[str, Column]:
    """numeric, signed, digits, scale and length of a picture such as S9(7)V99 or X(10)."""
    whole = F.regexp_replace(F.upper(pic), r"\s", "")
    run = lambda part: F.aggregate(
        F.regexp_extract_all(part, F.lit(r"([9X](?:\([0-9]+\))?)"), 1), F.lit(0),
        lambda n, x: n + F.when(F.contains(x, F.lit("(")), F.regexp_extract(x, r"\(([0-9]+)\)", 1).cast("int")).otherwise(1))
    after = F.when(F.contains(whole, F.lit("V")), F.regexp_extract(whole, "V(.*)$", 1)).otherwise("")
    total, scale = run(whole), run(after)
    numeric = ~F.contains(whole, F.lit("X"))
    return {"numeric": numeric, "signed": whole.startswith("S"), "digits": F.when(numeric, total), "scale": F.when(numeric, scale), "length": total}


def tables_read(sql: Column) -> Column:
    """Names after FROM (comma lists with aliases) and JOIN; subqueries name none."""
    lists = F.flatten(F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\bFROM\s+([A-Z0-9_.]+(?:\s+[A-Z0-9_]+)?(?:\s*,\s*[A-Z0-9_.]+(?:\s+[A-Z0-9_]+)?)*)"), 1), lambda x: F.split(x, r"\s*,\s*")))
    joins = F.regexp_extract_all(sql, F.lit(r"(?i)\bJOIN\s+([A-Z0-9_.]+)"), 1)
    return F.array_distinct(F.concat(F.transform(lists, lambda x: F.upper(F.regexp_extract(x, r"^\s*([A-Za-z0-9_.]+)", 1))), F.transform(joins, F.upper)))


def tables_written(sql: Column) -> Column:
    """Names after INSERT INTO, UPDATE and DELETE FROM."""
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+([A-Z0-9_.]+)"), 1), F.upper))


def canonical(*columns: str) -> Column:
    """JSON of columns in the order of their names."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})

"""The record of a change, from its message and its people: reasons, distinct people, open items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import text as T

#: Change types that count as emergencies.
EMERGENCIES = ("emergency", "expedited")


def distinct_people(people: Column) -> Column:
    """People (structs of name and email) in order, each once: whoever is the same person as one that is kept goes. Sameness isn't transitive, so the order counts."""
    none = F.filter(people, lambda p: F.lit(False))
    same = lambda p, q: T.same_person(p["name"], p["email"], q["name"], q["email"])
    return F.aggregate(people, none, lambda kept, p: F.when(F.exists(kept, lambda k: same(p, k)), kept).otherwise(F.concat(kept, F.array(p))))


def why(lines: Column, block: Column) -> dict[str, Column]:
    """subject, request (the first ticket of a change), change_type and emergency (null where no type is recorded)."""
    request = F.get(F.filter(T.tickets(lines, block), lambda t: t["type"] == "change"), F.lit(0))["id"]
    kind = F.lower(F.trim(F.get(T.values_of(block, "Change-type"), F.lit(0))))
    return {"subject": F.get(lines, F.lit(0)), "request": request, "change_type": kind, "emergency": kind.isin(*EMERGENCIES)}


#: What change control calls each thing that a message doesn't say.
OPEN = {
    "requester": "no requester recorded", "approver": "no approver recorded", "same": "an approver is also the implementer",
    "one": "an approver also implemented the change; another approver did not", "request": "no change request number", "type": "change type not recorded",
}


def open_items(lines: Column, block: Column, implementers: Column) -> Column:
    """What change control would ask for and the message doesn't say. implementers: structs of name and email."""
    approvers = F.filter(T.people_of(block, "Approved-by"), lambda p: ~T.is_agent(p["name"], p["email"]))
    own = lambda a: F.exists(implementers, lambda i: T.same_person(a["name"], a["email"], i["name"], i["email"]))
    reason = why(lines, block)
    approval = T.bound(F.transform(approvers, own), lambda same: F.when(F.size(same) == 0, OPEN["approver"]).when(F.forall(same, lambda x: x), OPEN["same"]).when(F.exists(same, lambda x: x), OPEN["one"]))
    return F.array_compact(F.array(
        F.when(F.size(T.values_of(block, "Requested-by")) == 0, OPEN["requester"]), approval,
        F.when(reason["request"].isNull(), OPEN["request"]), F.when(reason["change_type"].isNull(), OPEN["type"]),
    ))


#: What a record lacks.
GAPS = {
    "who": "who: implementer has no name or email", "when": "when: missing a time", "where": "where: repository, commit or files missing",
    "what": "what: a changed file was not accounted for", "how": "how: a text change has no hunks",
}


def gaps(record: Column) -> Column:
    """The gaps of a record (struct of name, email, authored, committed, repository, commit, files, accounted, problems and edits, an array of binary, insertions, deletions and hunks): an array of texts."""
    r = lambda name: record[name]
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    lost = ~none(r("problems")) | (F.size(F.array_except(F.coalesce(r("files"), F.array().cast("array<string>")), F.coalesce(r("accounted"), F.array().cast("array<string>")))) > 0)
    bare = F.exists(F.coalesce(r("edits"), F.array().cast("array<struct<binary:boolean,insertions:int,deletions:int,hunks:int>>")), lambda e: ~e["binary"] & ((e["insertions"] > 0) | (e["deletions"] > 0)) & (e["hunks"] == 0))
    return F.array_compact(F.array(
        F.when(empty(r("name")) | empty(r("email")), GAPS["who"]), F.when(empty(r("authored")) | empty(r("committed")), GAPS["when"]),
        F.when(empty(r("repository")) | empty(r("commit")) | none(r("files")), GAPS["where"]), F.when(lost, GAPS["what"]), F.when(bare, GAPS["how"])))

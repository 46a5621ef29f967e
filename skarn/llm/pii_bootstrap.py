"""Personal data by rules and by bootstrapped contextual extraction.

One pass over the whole texts finds the base entities (email, ip, card, phone) and every other token that holds a digit, with the lexical patterns
around it: the one and two words before, the word after, a key before ``=`` or ``:``, and the token's character shape; a value of letters only takes part if it has a key. Base entities are
the seeds, and so are long values of mixed letters and digits whose key says that they are secret. Spark then scores the
pattern-instance graph a fixed number of rounds: a pattern is as good as the share of confident instances among the distinct instances that it holds, and an
instance is as good as the noisy-or of its patterns. Tokens too short to identify anybody are fixed negatives. Instances above ``accept``
are added as ``secret`` (letters and digits) or ``number`` spans; base spans always stay and are never overlapped.

The graph's edges are distinct (pattern, instance) pairs, so a group of copies weighs as one; patterns and instances are aggregated partially before
they are shuffled and joined by splittable joins.

Defined cases: null text counts as empty (no spans); every row has its own result, so doc_id may be null or repeated; positions are code points, end exclusive;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret", "number")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, SPACE = re.compile(r"[0-9]"), re.compile(r"\s")
EDGE = "\"'`.,;:!?()[]{}<>"
#: A key and its sign before a value; keys whose values are secret; a token that may take part.
KEY = re.compile(r"([^\W\d][\w.-]{0,39})[ \t]{0,3}[=:][ \t]{0,3}[\"'`]?$")
SECRET_KEYS = {"token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "private_key", "client_secret"}
MAY = re.compile(r"[0-9=]")
#: Code points before and behind an observation in which its neighbouring words are looked for; a word that is cut by that is none.
BEFORE, BEHIND, SEED = 160, 80, 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rule entities, sorted. Each kind is found in one linear scan."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        # The local part can't hold an @, so the leftmost match is the whole run before it, back to the last match or @.
        run = text[floor:at]
        local = len(run) - len(run.rstrip(LOCAL))
        floor = at + 1
        if local and (m := DOMAIN.match(text, at + 1)):
            out.append((at - local, 0, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts, start = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((start, 1, end))
                start = end + 1
        for m in RUN.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word(w: str) -> str:
    return DIGIT.sub("0", w.strip(EDGE).lower())


def _shape(value: str) -> str:
    out = []
    for c in value:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return ("".join(sorted(set(out))) if len(out) > 6 else "".join(out)) + f":{min(len(value), 40) // 4}"


def observations(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind, instance, patterns): kind is that of a seed, 4 or 5 for a candidate, -1 for a negative."""
    if not base and not MAY.search(text):
        return []
    found, leads = [(a, b, k, text[a:b], "") for a, k, b in base], {}
    taken, pos, nxt = sorted((a, b) for a, _, b in base), 0, 0
    while m := MAY.search(text, pos):
        i = m.start()
        while nxt < len(taken) and taken[nxt][1] <= i:
            nxt += 1
        if nxt < len(taken) and taken[nxt][0] <= i:
            pos = taken[nxt][1]
            continue
        left = max(text.rfind(" ", pos, i), text.rfind("\n", pos, i), text.rfind("\t", pos, i), pos - 1) + 1
        s = SPACE.search(text, i)
        right = s.start() if s else len(text)
        if nxt < len(taken):
            right = min(right, taken[nxt][0])
        pos = right
        token = text[left:right]
        core = token.strip(EDGE)
        start = left + (token.find(core) if core else 0)
        key, eq, value = core.rpartition("=")
        if eq and key and value:
            start += len(key) + 1
            inner = value.strip(EDGE)
            start += value.find(inner) if inner else 0
            core = inner
        letters, digits = sum(c.isalpha() for c in core), sum("0" <= c <= "9" for c in core)
        if not core or not digits and not (eq and key and letters):
            continue
        lead = len(key) + 1 if eq else 0
        if not eq and letters + digits >= 10 and (named := KEY.search(text, max(0, start - 50), start)):
            key, lead = named.group(1), start - named.start()
        key = key if lead else ""
        kind = 4 if letters >= 2 and digits >= 2 and letters + digits >= 10 else 5 if not letters and digits >= 9 else 4 if key and not digits and letters >= 10 else -1
        if kind == 4 and digits >= 4 and letters + digits >= 20 and key.rpartition(".")[2].lower() in SECRET_KEYS:
            kind = SEED
        found.append((start, start + len(core), kind, core, key))
        leads[start] = lead
    out = []
    for a, b, kind, value, key in found:
        end = a - leads.get(a, 0)
        low, high = max(0, end - BEFORE), min(len(text), b + BEHIND)
        left, right = text[low:end].split(), text[b:high].split()
        if left and low and not text[low - 1].isspace() and not text[low].isspace():
            left[0] = ""
        if right and high < len(text) and not text[high].isspace() and not text[high - 1].isspace():
            right[-1] = ""
        before, after = [_word(w) for w in left[-2:]], [_word(w) for w in right[:2]]
        patterns = ["s " + _shape(value)]
        if before and before[-1]:
            patterns.append("l " + before[-1])
        if len(before) == 2:
            patterns.append("L " + " ".join(before))
        if after and (r := next((w for w in after if w), "")):
            patterns.append("r " + r)
        if key:
            patterns.append("k " + _word(key))
        out.append((a, b, kind, value, patterns))
    return out


_OBSERVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def scan(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document with a row number of its own, base spans and observations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        signed = lambda s: xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 5) - (1 << 63)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            bases, seen, rows = [], [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                seen.append([{"start": a, "end": b, "kind": k, "instance": signed(v), "patterns": [signed(p) for p in ps]} for a, b, k, v, ps in observations(t, base)])
                rows.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0), pa.array(bases, _BASE), pa.array(seen, _OBSERVED)], ["row", "doc_id", "base", "seen"])

    schema = "row long, doc_id long, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,end:int,kind:int,instance:long,patterns:array<long>>>"
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def confidences(seen: DataFrame, scratch: Scratch, rounds: int = 3, weight: float = 0.5, least_support: int = 2) -> DataFrame:
    """``(instance, confidence)`` of candidates, by iterated scoring of the pattern-instance graph. seen: kind, instance, patterns."""
    edges = scratch.table(seen.select("instance", F.when(F.col("kind").between(0, 3) | (F.col("kind") == SEED), 1).when(F.col("kind") == -1, -1).otherwise(0).alias("role"), F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("role").alias("role")), "edges")
    scored = edges.select("pattern", "instance", "role", F.when(F.col("role") == 1, 1.0).otherwise(0.0).alias("confidence"))
    result = None
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("confidence") / (F.count(F.lit(1)) + 2.0)).alias("score"), F.sum(F.when(F.col("confidence") >= 0.5, 1).otherwise(0)).alias("support")).where(F.col("support") >= least_support)
        open_edges = edges.where("role = 0").join(patterns.select("pattern", "score"), "pattern")
        result = scratch.table(open_edges.groupBy("instance").agg((1.0 - F.exp(F.sum(F.log1p(-weight * F.col("score"))))).alias("confidence")), "confidence")
        if k + 1 < rounds:
            scored = edges.join(result, "instance", "left").select("pattern", "instance", "role", F.when(F.col("role") == 1, 1.0).when(F.col("role") == -1, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return result


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = 0.75, rounds: int = 3) -> DataFrame:
    """One row per document: ``doc_id, base, spans``: arrays of (start, rank, kind, end), sorted."""
    scratch = Scratch(documents.sparkSession, "pii")
    docs = scratch.table(scan(documents, doc_id, text), "scan")
    seen = docs.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    good = confidences(seen, scratch, rounds).where(F.col("confidence") >= accept).select("instance")
    # A seed that patterns hold is as sure as a candidate can be; one without is a span, too.
    seeds = seen.where(F.col("kind") == SEED).select("instance").distinct()
    good = good.unionByName(seeds).distinct()
    seen = seen.withColumn("kind", F.when(F.col("kind") == SEED, 4).otherwise(F.col("kind")))
    span = lambda start, rank, end: F.struct(F.col(start).alias("start"), F.col(rank).alias("rank"), F.element_at(F.array(*map(F.lit, KINDS)), F.col(rank) + 1).alias("kind"), F.col(end).alias("end"))
    added = seen.where("kind >= 4").join(good, "instance", "left_semi").groupBy("row").agg(F.collect_set(span("start", "kind", "end")).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("rank"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    joined = docs.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))

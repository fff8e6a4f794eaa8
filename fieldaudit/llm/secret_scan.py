"""Operator 11: secrets in texts, told apart by how many owners have the same value in the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import cut, free, keep

#: The base kinds: pattern, group with the value, its least length. The name before an assigned value is in either case, A-Z and a-z only.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
BASE = {"assign": (ASSIGN, 2, 8), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32)}
#: Public forms of credentials that the base kinds don't have: kind, pattern, group with the value.
FORMS = (
    ("userinfo", re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@'\"<>]{1,64}:([^\s/:@'\"<>]{6,128})@"), 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))+-----END (?:[A-Z]+ )?PRIVATE KEY-----"), 0),
    ("vendor", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|ASIA[A-Z0-9]{12,})"), 0),
    ("random", re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+_-]{24,128}={0,2}(?![A-Za-z0-9+/=_.-])"), 0),
)
#: A text without any of these has no match of the form, so its pattern isn't tried.
HINTS = {"userinfo": ("://",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY-----",), "vendor": ("_", "-", "AIza", "ASIA")}
#: Forms whose shape alone tells a live-looking value.
SHAPED = ("jwt", "pem")
KINDS = (*BASE, *(kind for kind, _, _ in FORMS))
#: A value of at most OWNERS owners is specific to them, one of COPIED owners or more is a widely copied example.
OWNERS, COPIED = 2, 3
#: Bits a character that a live-looking value has at least, and the parts of placeholders that none holds.
BITS = 2.5
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "1234567", "abcdef", "....", "----", "____")
#: At most so many values are joined as hot ones, each with over a HOT-th of all spans; so they are fewer than HOT.
HOT = 2_000


def entropy(value: str) -> float:
    """Bits a character of value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether value looks like one that a machine or a careful person made: even frequencies, no placeholder, and digits among its letters."""
    low = value.lower()
    return entropy(value) >= BITS and not any(p in low for p in PLACEHOLDERS) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def looks_random(value: str) -> bool:
    """A bare token must show more, as no name stands beside it: both cases and digits, all of them often, and near-even frequencies."""
    share = [sum(map(test, value)) for test in (str.isupper, str.islower, str.isdigit)]
    return min(share) >= 3 and entropy(value) >= 3.7


def base_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind's number, start, end, value) of the base kinds, whole matches from left to right; those with too short a value are dropped."""
    low = text.lower()
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind == "assign" and not any(w in low for w in ("pass", "secret", "token", "api")) or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                yield k, m.start(), m.end(), m.group(group)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """Spans of FORMS that overlap none of taken and none of an earlier form; live-looking values only."""
    taken = merged(taken)
    long_word = None
    for k, (kind, pattern, group) in enumerate(FORMS, len(BASE)):
        if kind == "random":
            long_word = max(map(len, text.split()), default=0) if long_word is None else long_word
            if long_word < 24:
                continue
        elif not any(h in text for h in HINTS[kind]):
            continue
        fresh = []
        for m in pattern.finditer(text):
            value = m.group(group)
            if (kind in SHAPED or looks_live(value)) and (kind != "random" or looks_random(value)):
                fresh.append((k, m.start(), m.end(), value))
        at, kept = 0, []
        for span in fresh:
            while at < len(taken) and taken[at][1] <= span[1]:
                at += 1
            if at == len(taken) or taken[at][0] >= span[2]:
                kept.append(span)
        yield from kept
        taken = merged(taken + [(a, b) for _, a, b, _ in kept])


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())])


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, repository, owner, n_assign, n_access, n_hex, base_sha256, found (kind, start, end, 128-bit hash of the value, whether it looks live) of each row of docs; values themselves stay in the worker."""

    def run(batches):
        keep("secret_scan")
        for batch in batches:
            counts, shas, found = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
                spans = base + list(added_spans(text, [(a, b) for _, a, b, _ in base]))
                counts.append([sum(s[0] == k for s in base) for k in range(3)])
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
                found.append([{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "live": KINDS[k] in SHAPED or looks_live(v)} for k, a, b, v in spans])
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *n, pa.array(shas, pa.string()), pa.array(found, pa.list_(SPAN))],
                ["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(
        run,
        "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,value:binary,live:boolean>>",
    )


def ownership(spans: DataFrame) -> DataFrame:
    """value, n_spans, n_repositories, n_owners over all spans (value, repository, owner); counted before each shuffle, so that a value of very many rows moves as one row a task."""
    places = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owners = places.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return owners.groupBy("value").agg(F.sum("n").alias("n_spans"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(spans: DataFrame) -> DataFrame:
    """spans with n_repositories and n_owners of their values. Values with over a HOT-th of all spans, fewer than HOT rows, are broadcast; the other values' rows are shuffled."""
    seen = cut(ownership(spans))
    hot = F.col("n_spans") * HOT > F.lit(seen.agg(F.sum("n_spans")).first()[0] or 0)
    few, many = F.broadcast(seen.where(hot).drop("n_spans")), seen.where(~hot).drop("n_spans")
    marked = spans.join(few, "value", "left")
    ready, rest = marked.where("n_owners IS NOT NULL"), marked.where("n_owners IS NULL").drop("n_owners", "n_repositories")
    return ready.unionByName(rest.join(many.hint("shuffle_hash"), "value"))


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_copied and secrets for every row of docs.

    Base spans are of the three base kinds; spans of other forms are added where they overlap none and fewer than COPIED owners have the value.
    A value's class is by the whole corpus: "copied" if COPIED owners or more have it, "live" if at most OWNERS do and it looks
    live (see looks_live), else "unclear". secrets has kind, start, end, class, n_repositories and n_owners of each span, by start, then kind.
    repository and owner are columns of docs: source, and the part of source before a slash, unless given. Null ones are one unknown
    repository and owner. A null or empty text has no spans. Repeated rows are scanned and counted again. Extra columns aren't read.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.substring_index(F.col("source"), "/", 1) if owner is None else owner
    found = cut(candidates(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    one = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    spans = found.where(F.size("found") > 0).select("row", *one, "repository", "owner", F.explode("found").alias("s")).select("row", *one, "repository", "owner", "s.*")
    class_ = F.when(F.col("n_owners") >= COPIED, "copied").when(F.col("live") & (F.col("n_owners") <= OWNERS), "live").otherwise("unclear")
    told = judged(spans).select("row", *one, F.struct("start", "kind", "end", class_.alias("class"), "n_repositories", "n_owners").alias("s"))
    told = told.where((F.col("s.kind") < len(BASE)) | (F.col("s.class") != "copied"))
    lists = told.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    out = found.where(F.size("found") > 0).select("row", *one).join(lists, "row", "left").drop("row")
    none = found.where(F.size("found") == 0).select(*one, F.lit(None).cast(lists.schema["s"].dataType).alias("s"))
    every = out.unionByName(none).withColumn("s", F.coalesce("s", F.array().cast(lists.schema["s"].dataType)))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    count = lambda test: F.size(F.filter("s", test)).cast("long")
    return every.select(
        *one,
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",").alias("spans"),
        count(lambda x: x["kind"] >= len(BASE)).alias("n_added"), count(lambda x: x["class"] == "live").alias("n_live"), count(lambda x: x["class"] == "copied").alias("n_copied"),
        F.transform("s", lambda x: F.struct(name(x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["class"].alias("class"), x["n_repositories"].alias("n_repositories"), x["n_owners"].alias("n_owners"))).alias("secrets"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("secrets")

"""Personal data: base patterns, and bootstrapped contextual extraction.

What the base patterns find are seed entities, and so are key ids and long hex strings, as secrets. Any word that no
seed covers is an instance, by its value: the word less the label and the punctuation around it. What stands before an
instance is its lexical pattern: the label glued to it or before it (`mail:x`, `mail: x`, `token = "x"`), else the two
words before with the form of the value; bare digits have no pattern without a label. Spark scores the graph of
patterns and distinct values in rounds. A pattern of a kind scores the sum of its values' scores over their number plus
`doubt`; seeds score 1, another value its best pattern's score times the share of its occurrences that such patterns
have. Patterns with `support` scored values and a score of `confident` then tag what they surround.

Texts are read again only for what a round asks: how often a candidate pattern occurs, then the values of those that at
least `confident` / 2 of their occurrences speak for, then where else the values they reach occur. The rounds end when
nothing changes any more.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_out, join_hot, mix, take_memory, text_bytes, with_key, written
from corvane.llm.repeats import slices

#: Kinds of the base, in their order, and what the seeds and patterns may add: fixed values.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the start of a run of digits or fails for all of it, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Seeds for secrets: key ids, and hex strings of 32 or more with digits and letters.
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64})(?![A-Za-z0-9])"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each @ is tried once, with all the local part before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind as its place in KINDS, start, end), by kind and then start."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


OPEN, CLOSE, QUOTES = b"\"'([{<", b"\"')]}>,.;:!?", b"\"'"
MARKS = (b"=", b":", b"#")
LOWER_HEX, CAPITALS = b"0123456789abcdef", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Forms of a value: any other, digits, lower hex, capitals with digits.
OTHER, DIGITS, HEX, UPPER = range(4)


def form(value: bytes) -> int:
    if value.isdigit():
        return DIGITS
    return HEX if not value.strip(LOWER_HEX) else UPPER if not value.strip(CAPITALS) else OTHER


def parse(word: bytes) -> tuple[bytes, int, int]:
    """The label glued to a word's value, its mark included, and where the value starts and ends."""
    lead = len(word) - len(word.lstrip(OPEN))
    body = word[lead:].rstrip(CLOSE)
    i = body.rfind(b"=")
    i = body.rfind(b":") if i < 0 else i
    value = body[i + 1 :].lstrip(QUOTES)
    end = lead + len(body)
    return body[: i + 1], end - len(value), end


def lower(word: bytes) -> bytes:
    return word.lower() if word.isascii() else word.decode(errors="replace").lower().encode()


def digest64(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x)


class Lexicon(dict):
    """The number of each word, and by it: hashes of the word in lower case, of its label (0 without one) and of its
    value (0 if empty), the value's form, whether the word ends in a mark, and whether it has no letter or digit."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most
        self.room(1 << 16)

    def room(self, n: int) -> None:
        old = getattr(self, "low", np.empty(0)).size
        for name, kind in (("low", np.uint64), ("label", np.uint64), ("value", np.uint64), ("form", np.uint8), ("mark", bool), ("pure", bool)):
            x = np.zeros(n, kind)
            if old:
                x[:old] = getattr(self, name)
            setattr(self, name, x)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n >= self.low.size:
            self.room(2 * n)
        if word.isalpha():
            self.low[n] = digest64(word.lower())
            self.value[n] = digest64(word)
            self.label[n], self.mark[n], self.pure[n] = 0, False, False
            self.form[n] = form(word)
        else:
            label, s, e = parse(word)
            self.low[n] = digest64(lower(word.lstrip(OPEN)))
            self.label[n] = digest64(lower(label)) if label else 0
            self.value[n] = digest64(word[s:e]) if e > s else 0
            self.form[n] = form(word[s:e])
            self.mark[n] = word.rstrip(QUOTES).endswith(MARKS)
            self.pure[n] = word.isascii() and not any(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in word)
        self[word] = n
        return n


LEXICON = Lexicon()

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Words:
    """The words of several texts, one text after another."""

    def __init__(self, texts: list[bytes]):
        take_memory("pii", LEXICON.clear)
        if len(LEXICON) > LEXICON.most:
            LEXICON.clear()
        words = [t.split() for t in texts]
        count = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(count)
        self.id = np.fromiter(chain.from_iterable(map(LEXICON.__getitem__, w) for w in words), np.int64, int(count.sum()))
        self.place = np.arange(self.id.size) - np.repeat(self.ends - count, count)  # in its text
        self.value = LEXICON.value[self.id]

    def patterns(self, at: np.ndarray | None = None, label: np.ndarray | None = None, form: np.ndarray | None = None) -> np.ndarray:
        """Hash of the pattern before each word, or before each of the words at `at` with labels and forms as given;
        0 for none."""
        x = LEXICON
        if at is None:
            at, label, form = np.arange(self.id.size), x.label[self.id], x.form[self.id]
        one, two = self.id[np.maximum(at - 1, 0)], self.id[np.maximum(at - 2, 0)]
        has_one, has_two = self.place[at] > 0, self.place[at] > 1
        near, far = np.where(has_one, x.low[one], np.uint64(0)), np.where(has_two, x.low[two], np.uint64(0))
        after_mark = has_one & x.mark[one]
        words = mix(near * _M[0] + far * _M[1] + form.astype(np.uint64) + _M[2])
        out = np.where(has_two & (form != DIGITS), words, np.uint64(0))
        out = np.where(after_mark, np.where(x.pure[one], mix(near * _M[0] + far + _M[3]), mix(near + _M[3])), out)
        return np.where(label != 0, mix(label + _M[3]), out)


ROW = "doc_id long, text string, spans array<struct<kind:int,start:int,end:int>>, seeds array<struct<start:int,end:int,value:long,kind:int,pattern:long>>, taken array<int>"


def seeds_of(text: str, spans: list[tuple[int, int, int]], secret: re.Pattern) -> tuple[list[dict], list[int]]:
    """The seeds of a text with their patterns, and the places of the words that base spans or seeds overlap."""
    found = [(s, e, k) for k, s, e in spans]
    reach = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in reach], list(accumulate((e for _, e in reach), max))  # how far the spans so far go
    for m in secret.finditer(text):
        i = bisect_left(starts, m.end())
        if not i or ends[i - 1] <= m.start():
            found.append((m.start(), m.end(), len(BASE)))
    if not found:
        return [], []
    words = Words([text.encode()])
    starts = [m.start() for m in WORD.finditer(text)]
    taken: set[int] = set()
    at, label, forms = [], [], []
    for s, e, _ in found:
        i = bisect_right(starts, s) - 1
        glued = lower(text[starts[i] : s].encode().lstrip(OPEN).rstrip(QUOTES))
        at.append(i)
        label.append(digest64(glued) if glued else 0)
        forms.append(form(text[s:e].encode()) if not glued or glued.endswith(MARKS) else -1)
        while i < len(starts) and starts[i] < e:
            taken.add(i)
            i += 1
    known = np.array(forms) >= 0  # else something without a mark is glued to it
    p = words.patterns(np.array(at), np.array(label, np.uint64), np.maximum(forms, 0).astype(np.uint8))
    p = np.where(known, p, np.uint64(0)).view(np.int64).tolist()
    value = [digest64(text[s:e].encode()) for s, e, _ in found]
    signed = np.array(value, np.uint64).view(np.int64).tolist()
    return [{"start": s, "end": e, "value": v, "kind": k, "pattern": x} for (s, e, k), v, x in zip(found, signed, p)], sorted(taken)


def scan(docs: DataFrame, secret: str = SECRET) -> DataFrame:
    """docs: doc_id, text. Each row with its base spans, its seeds, and the words that they take."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    seed = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("kind", pa.int32()), ("pattern", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(secret)
        for b in batches:
            spans, seeds, taken = [], [], []
            for t in b.column(1).to_pylist():
                x = base_spans(t or "")
                spans.append([dict(zip(("kind", "start", "end"), y)) for y in x])
                found, words = seeds_of(t or "", x, pattern)
                seeds.append(found)
                taken.append(words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span), pa.array(seeds, seed), pa.array(taken, pa.list_(pa.int32()))], ["doc_id", "text", "spans", "seeds", "taken"])

    return docs.mapInArrow(run, ROW)


#: Bits of a filter for hashes, by their lowest digits; what passes is joined with the hashes themselves.
BITS = 2**23
GIVES = {"count": "key long, n long", "pairs": "pattern long, value long, n long", "rows": "uid long, start int, end int, pattern long, value long"}


def look_up(own: DataFrame, by: str, wanted: DataFrame, give: str) -> DataFrame:
    """What the rows of scan() have of the instances whose `by`, pattern or value, is in wanted, a column of distinct
    hashes of that name. give: count, how often each occurs; pairs, each pattern and value and how often; rows, where."""
    set_bits = wanted.select(F.col(by).bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()
    bits = np.zeros(BITS, bool)
    bits[set_bits] = True
    packed = own.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    names = [x.split()[0] for x in GIVES[give].split(", ")]

    def places(words: Words, texts: list[bytes], hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of hits in order: their text, and where the value starts and ends in code points."""
        owner = np.searchsorted(words.ends, hit, side="right")
        start, end, known, at = [], [], -1, []
        for t, i in zip(owner.tolist(), words.place[hit].tolist()):
            if t != known:
                text, known = texts[t].decode(errors="replace"), t
                at = [(m.start(), m.group()) for m in WORD.finditer(text)]
            s, word = at[i]
            raw = word.encode()
            _, a, b = parse(raw)
            start.append(s + len(raw[:a].decode(errors="replace")))
            end.append(s + len(raw[:b].decode(errors="replace")))
        return owner, np.array(start, np.int32), np.array(end, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.unpackbits(np.frombuffer(packed.value, np.uint8)).view(bool)
        low = np.uint64(BITS - 1)
        for whole in batches:
            for lo, hi in slices(whole.column(1)):
                b = whole.slice(lo, hi - lo)
                texts = text_bytes(b.column(1))
                words = Words(texts)
                p = words.patterns()
                free = (p != 0) & (words.value != 0)
                taken, owner = b.column(2).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
                free[np.append(0, words.ends)[owner] + taken] = False
                key = p if by == "pattern" else words.value
                hit = np.flatnonzero(free & has[(key & low).astype(np.int64)])
                p, v, key = (x[hit].view(np.int64) for x in (p, words.value, key))
                if give == "count":
                    out = np.unique(key, return_counts=True)
                elif give == "pairs":
                    pairs, n = np.unique(np.stack((p, v)), axis=1, return_counts=True)
                    out = (*pairs, n)
                else:
                    text, start, end = places(words, texts, hit)
                    out = (b.column(0).to_numpy()[text], start, end, p, v)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    got = (own if set_bits.size else own.limit(0)).select("uid", "text", "taken").mapInArrow(run, GIVES[give])
    if give == "count":
        got = got.groupBy("key").agg(F.sum("n").alias("n")).withColumnRenamed("key", by)
    elif give == "pairs":
        got = got.groupBy("pattern", "value").agg(F.sum("n").alias("n"))
    return got.join(wanted, by, "left_semi")


def signature(df: DataFrame) -> tuple:
    """The same for the same rows in any order, with scores to three digits."""
    cols = [F.round(c, 3) if c == "score" else F.col(c) for c in df.columns]
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first())


def score_patterns(own: DataFrame, rounds: int | None = None, support: int = 5, confident: float = 0.8, doubt: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score, n) of the confident patterns, and (uid, start, end, pattern, value) of the instances of all
    patterns that were followed, from the rows of scan(). The rounds end when patterns, values and their scores, to
    three digits, stay as they were, which they come to as they only grow; or after `rounds`, if that is given."""
    least = confident / 2 * (support + doubt) - 1e-3
    best = lambda x: (F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"), *x)
    # Where seeds stand: pattern, value, kind, occurrences; later also where values stand that patterns reach.
    seeds = written(own.select(F.explode("seeds").alias("s")).groupBy("s.pattern", "s.value", "s.kind").agg(F.count("*").alias("n")), "pii-seeds")
    seed_n = seeds.groupBy("pattern").agg(F.sum("n").alias("seeds"))
    standing, asked, reached = None, None, None
    followed, found, out = None, None, None
    last, more = None, None
    for k in itertools.count():
        context = seeds.where("pattern <> 0").withColumn("score", F.lit(1.0))
        if reached is not None:
            context = context.unionByName(standing.join(reached, "value").select("pattern", "value", "kind", "n", "score"))
        gain = context.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("k"), F.sum(F.col("score") * F.col("n")).alias("spoken"))
        gain = written(gain.where((F.col("k") >= support) & (F.col("s") >= least)), "pii-gain")
        candidate = gain.groupBy("pattern").agg(F.max("spoken").alias("spoken"))
        if followed is not None:
            candidate = candidate.join(followed, "pattern", "left_anti")
        candidate = written(candidate, "pii-candidates")
        if candidate.take(1):
            other = look_up(own, "pattern", candidate.select("pattern"), "count")
            told = candidate.join(other, "pattern", "left").join(seed_n, "pattern", "left")
            every = F.coalesce("n", F.lit(0)) + F.coalesce("seeds", F.lit(0))
            new = written(told.where(F.col("spoken") >= confident / 2 * every).select("pattern"), "pii-followed")
            if new.take(1):
                rows = written(look_up(own, "pattern", new, "rows"), "pii-rows")
                followed, found = (new, rows) if followed is None else (followed.unionByName(new), found.unionByName(rows))
        if followed is None:
            break
        members = found.select("pattern", "value").unionByName(seeds.select("pattern", "value").join(followed, "pattern", "left_semi")).distinct()
        degree = members.groupBy("pattern").agg(F.count("*").alias("n"))
        out = written(gain.join(degree, "pattern").select("pattern", "kind", F.round(F.col("s") / (F.col("n") + doubt), 6).alias("score"), "n"), "pii-patterns")
        now = signature(out), None if reached is None else signature(reached)
        if k + 1 == rounds or now == last and not more.take(1):
            break
        last = now
        good = out.where(F.col("score") >= confident / 2).groupBy("pattern").agg(*best([F.max("n").alias("n")]))
        inside = join_hot(found.select("pattern", "value"), good, ["pattern"]).groupBy("value").agg(*best([F.count("*").alias("inside")]))
        inside = written(inside.join(seeds.select("value"), "value", "left_anti"), "pii-inside")
        fresh = inside.select("value") if asked is None else inside.select("value").join(asked.select("value"), "value", "left_anti")
        fresh = written(fresh, "pii-asked")
        if fresh.take(1):
            count = written(look_up(own, "value", fresh, "count"), "pii-counts")
            asked = count if asked is None else asked.unionByName(count)
        elif reached is None:
            break
        share = F.col("inside") / F.greatest("n", "inside")
        before, reached = reached, inside.join(asked, "value").select("value", "kind", F.round(F.col("score") * share, 6).alias("score"))
        reached = written(reached.where(F.col("score") >= confident / 2), "pii-values")
        more = reached.select("value") if before is None else reached.select("value").join(before.select("value"), "value", "left_anti")
        more = written(more, "pii-new-values")
        if more.take(1):
            pairs = written(look_up(own, "value", more, "pairs"), "pii-contexts")
            standing = pairs if standing is None else standing.unionByName(pairs)
        elif before is None:
            break
    spark = own.sparkSession
    if out is None:
        return spark.createDataFrame([], "pattern long, kind int, score double, n long"), spark.createDataFrame([], GIVES["rows"])
    return written(out.where(F.col("score") >= confident).groupBy("pattern").agg(*best([F.max("n").alias("n")])), "pii-good"), found


def find_personal_data(docs: DataFrame, secret: str = SECRET, **how) -> DataFrame:
    """doc_id, spans (the base), added (seeds for secrets, and what patterns found), each array<struct<kind, start, end>> by kind and start.

    Places are code points, ends exclusive; null text is empty. Added spans never overlap base spans. Rows that
    repeat a doc_id, or have none, are scanned one by one. Other columns are ignored.
    """
    own = written(scan(with_key(docs, "doc_id", ("text", "text")), secret).withColumn("uid", F.monotonically_increasing_id()), "pii-scan", compression="zstd")
    good, found = score_patterns(own, **how)
    hits = join_hot(found.select("uid", "start", "end", "pattern"), good, ["pattern"]).select("uid", "kind", "start", "end")
    secrets = own.select("uid", F.explode("seeds").alias("s")).select("uid", "s.kind", "s.start", "s.end").where(f"kind >= {len(BASE)}")
    added = hits.unionByName(secrets).groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    out = own.select("doc_id", "uid", "spans").join(added, "uid", "left")
    # Seeds keep off base spans, and the words of both are no instances: nothing that is added overlaps a base span.
    return out.select(id_out(), "spans", F.coalesce("added", F.array()).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    every = F.array_sort(F.concat("spans", "added"))
    return found.select("doc_id", *counts, F.sha2(shown(F.col("spans")), 256).alias("base_sha256"), shown(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))

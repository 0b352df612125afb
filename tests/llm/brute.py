"""Plain renditions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def runs(mark):
    return sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))


def repeats(docs, w):
    count = Counter(b[i : i + w] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - w + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        mark = [0] * len(b)
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                mark[i : i + w] = [1] * w
        out.append((d, len(b), sum(mark), runs(mark), sha(bytes(c for c, m in zip(b, mark) if not m))))
    return out


def later_copies(docs, w):
    first = {}
    for d, t in docs:
        x = WORD.findall(t or "")
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        x = WORD.findall(t or "")
        mark = [0] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < d:
                mark[i : i + w] = [1] * w
        out.append((d, len(x), sum(mark), sha(" ".join(y for y, m in zip(x, mark) if not m))))
    return out


def contaminated(docs, items, w):
    windows = {}
    for i, t in items:
        x = ALNUM.findall(lower(t))
        n = min(w, len(x))
        for s in range(len(x) - n + 1) if n else ():
            windows.setdefault(tuple(x[s : s + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        x = ALNUM.findall(lower(t))
        mark, found = [0] * len(x), set()
        for n in {len(k) for k in windows}:
            for s in range(len(x) - n + 1):
                if got := windows.get(tuple(x[s : s + n])):
                    mark[s : s + n] = [1] * n
                    found |= got
        out.append((d, len(x), sum(mark), len(found), sha(",".join(sorted(found))), sum(mark) > 0))
    return out


def linked(docs, k, percent):
    sets = {}
    for d, t in docs:
        x = WORD.findall(lower(t))
        n = min(k, len(x))
        sets[d] = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d)) for d, _ in docs]


def base_quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        x = WORD.findall(t)
        c = Counter(tuple(x[i : i + 3]) for i in range(len(x) - 2))
        mark = [0] * len(x)
        for i in range(len(x) - 2):
            if c[tuple(x[i : i + 3])] > 1:
                mark[i : i + 3] = [1] * 3
        lines = [y for y in t.split("\n") if WORD.search(y)]
        out.append((d, len(x), sum(map(len, x)), sum(y in "#*$%&|<>" for y in t), len(lines) - len(set(lines)), sum(mark), len(x) < 50 or 100 * sum(mark) > 50 * len(x)))
    return out


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]


def verdicts(docs, labels, orders, bits=18, smooth=1.0, window=16, caution=3.0):
    """doc_id: kept, by plain counting. Buckets and halves are the operator's own; all else is done anew."""
    import numpy as np

    from corvane.llm.common import gram_hashes, mix, word_hashes

    def bucket(words, k):
        h = word_hashes([w.encode() for w in words])
        h = mix(h) if k == 1 else gram_hashes(h, k)
        return (h >> np.uint64(64 - bits)).tolist()

    worst = {}
    for d, quality, toxic in labels:
        if d is not None and quality is not None:
            worst[d] = worst.get(d, True) and quality == 1 and not toxic
    half = {d: int(mix(np.array([d], np.int64).view(np.uint64) + np.uint64(77))[0]) >> 63 == 1 for d in worst}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    ratio = {}
    for k, weight in orders.items():
        raw, target = Counter(), Counter()
        for d, x in words:
            b = Counter(bucket(x, k))
            raw += b
            if worst.get(d) and not half[d]:
                target += b
        n, m = sum(raw.values()), sum(target.values())
        ratio[k] = {b: weight * float(np.log((target[b] + smooth) / (c * (m / n) + smooth))) if m else 0.0 for b, c in raw.items()}
    failed = {i: r[-1] for i, r in enumerate(base_quality(docs))}
    score = []
    for _, x in words:
        per = [0.0] * len(x)
        for k in orders:
            for i, b in enumerate(bucket(x, k)) if len(x) >= k else ():
                per[i] += ratio[k][b]
        mean = sum(per) / max(1, len(per))
        low = min((sum(per[i : i + window]) / window for i in range(len(per) - window + 1)), default=mean)
        score.append(mean + low)
    held = {}
    for i, (d, _) in enumerate(words):
        if d in worst and half[d] and not failed[i]:
            held[d] = min(held.get(d, score[i]), score[i])
    good, bad = [s for d, s in held.items() if worst[d]], [s for d, s in held.items() if not worst[d]]
    gain = lambda t: sum(s < t - 1e-9 for s in bad) / len(bad) - caution * sum(s < t - 1e-9 for s in good) / len(good)
    least = max(sorted(good + bad), key=lambda t: round(gain(t), 9)) if good and bad else float("-inf")
    return [(d, not failed[i] and score[i] >= least - 1e-8) for i, (d, _) in enumerate(words)]


def recurring_lines(docs, min_docs=5, lead=2, steady=0.2, share=0.6, fields=4):
    """Each text without the lines of recurring templates."""
    mask = lambda t: re.sub(r"[^\S\n]{2,}|[\t\x0b\f\r]", " ", re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", t))
    shown = lambda t: [(y if not x.replace("<*>", "").replace(" ", "") else x).strip(" ") for y, x in zip(t.split("\n"), mask(t).split("\n"))]
    texts, spans = {}, {}
    for _, t in docs:
        for x in shown(t) if t is not None else ():
            if x:
                texts.setdefault(x, set()).add(mask(t))
    cut = {}
    for x in texts:
        k = x.split(" ")
        n = min(fields, max(0, len(k) - lead))
        at = [lead + j * (len(k) - lead) // n for j in range(n)] + [len(k)] if n else []
        cut[x] = ((len(k), *k[:lead]), [" ".join(k[at[j] : at[j + 1]]) for j in range(n)])
    size, often = Counter(b for b, _ in cut.values()), Counter((b, j, f) for b, fs in cut.values() if len(fs) > 2 for j, f in enumerate(fs))
    for x, (b, fs) in cut.items():
        held = tuple((j, f) for j, f in enumerate(fs) if len(fs) > 2 and often[b, j, f] > 1 and often[b, j, f] >= steady * size[b])
        if len(fs) > 2 and share * len(fs) <= len(held) < len(fs):
            spans.setdefault((b, held), []).append(x)
    gone = {x for x, s in texts.items() if len(s) >= min_docs}
    for lines in spans.values():
        if len(set().union(*(texts[x] for x in lines))) >= min_docs:
            gone |= set(lines)
    keep = lambda t: [y for y, x in zip(t.split("\n"), shown(t)) if x not in gone]
    return [(d, None if t is None else "\n".join(keep(t))) for d, t in docs]


def secrets(docs, rules):
    """(doc_id, counts of the first three kinds, hash of their spans, all spans)."""
    out = []
    for d, t in docs:
        spans = []
        for k, r in enumerate(rules):
            for m in re.finditer(r.regex, t or "", re.ASCII):
                if len(m[r.group]) >= r.least:
                    spans.append((m.start(), k, m.end()))
        spans.sort()
        text = lambda xs: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in xs)
        out.append((d, *(sum(k == i for _, k, _ in spans) for i in range(3)), sha(text([s for s in spans if s[1] < 3])), text(spans)))
    return out


def trie(turns, every=20, most=4):
    """Rows of op12 from (conv_id, turn, role, text); every = 0: conversations as they are."""
    import zlib

    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, x in own.items()}
    if every:
        h = {c: zlib.crc32(str(c).encode()) % most for c in own}
        own = {c: own.get(c - c % every, [])[: h[c]] + own[c][h[c] :] for c in own}
    members, ends = {}, {}
    for c, x in own.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
        ends.setdefault(tuple(x), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in members if q}
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below),
                    sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q), sha(",".join(map(str, sorted(ends.get(p, []))))))
                   )
    return out


def collocations(docs, least=10, top=2000, share=50):
    """Rows of op13 from (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + 2]) for (lang, p), a in often.items() if len(p) == 3 for i in (0, 1) if 100 * a >= share * f[lang, p[i : i + 2]]}
    rows = {}
    for (lang, p), a in often.items():
        if (lang, p) not in gone:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, each in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(each)[:top], 1)]


def random_page(r, host_boxes):
    """A well-formed page as html, and its blocks as (text, box): box names what recurs, None what is the article's own."""
    word = lambda: r.choice(["alpha", "beta", "Gamma", "é", "1", "x-y"])
    inline = lambda: r.choice([word(), f"<b class='social'>{word()}</b>", f"<span class=\"ad\">{word()} <i>{word()}</i></span>", f"<label>{word()}</label>", "&amp;"])
    plain = lambda h: re.sub("<[^>]*>", "", h).replace("&amp;", "&")

    def paragraph():
        body = " ".join(inline() for _ in range(r.randint(1, 6))) + f" {r.random()}"
        tag = r.choice(["p", "h2", "blockquote", "p class='share-price'", "p class='notice'"])
        return f"<{tag}>{body}</{tag.split()[0]}>", [(plain(body), None)]

    def junk():
        return r.choice([f"<div class='{c}'><p>{r.random()}</p></div>" for c in ("ad", "cookie-notice", "share buttons", "adBox")] + [f"<nav>{r.random()}</nav>", f"<form><label>{r.random()}</label></form>", f"<section id='comments'><article><p>{r.random()}</p></article></section>", "<script>x='</p>'</script>", "<!-- <p>no</p> -->"]), []

    def block():
        kind = r.random()
        if kind < 0.5:
            return paragraph()
        if kind < 0.7:
            return junk()
        inner = [block() for _ in range(r.randint(1, 3))]
        name = r.choice(["div class='notice-of-motion'", "div", "section", "div class='text'"])
        return f"<{name}>{''.join(h for h, _ in inner)}</{name.split()[0]}>", [b for _, bs in inner for b in bs]

    body = [block() for _ in range(r.randint(1, 6))]
    boxes = [(f"<div class='k{i}'>{t}</div>", [(t, (i, t))]) for i, t in enumerate(host_boxes) if r.random() < 0.6]
    parts = [("<header><h1>Site</h1></header>", []), junk(), *boxes, (f"<article>{''.join(h for h, _ in body)}</article>", [b for _, bs in body for b in bs]), junk(), ("<footer>foot</footer>", [])]
    return "".join(h for h, _ in parts), [b for _, bs in parts for b in bs]


def page_texts(pages, min_pages=5, min_share=0.1):
    """page_id to text of (page_id, host, blocks): boxes that recur on the host go."""
    n, size = Counter(), Counter(h for _, h, _ in pages)
    for _, host, blocks in pages:
        n.update({(host, box) for _, box in blocks if box})
    gone = {k for k, c in n.items() if c >= min_pages and c >= min_share * size[k[0]]}
    return {i: "\n\n".join(" ".join(t.split()) for t, box in blocks if not box or (host, box) not in gone) for i, host, blocks in pages}

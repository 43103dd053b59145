"""Plain versions of the contracts, in one process, for comparison."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = sorted((i, label) for label, p in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def licenses(text, spec):
    """Labels, score and spans: each template is laid over the text at every shift."""
    ws, spans, score = license_words(text), [], 0.0
    phrases = [(label, license_words(t), True) for label, t in spec.PHRASES.items()]
    for number, (label, t, exact) in enumerate([*phrases, *((label, license_words(t), False) for label, t in spec.TEMPLATES)]):
        places = defaultdict(list)
        for i in range(len(t) - 2):
            places[tuple(t[i : i + 3])].append(i)
        lines = defaultdict(list)
        for pos in range(len(ws) - 2):
            for i in places.get(tuple(ws[pos : pos + 3]), ()):
                lines[pos - i].append((pos, i))
        alone = {d for d, h in lines.items() if exact or len({i + k for _, i in h for k in range(3)}) == len(t)}
        merged, before = [lines[d] for d in alone], None
        for shift in sorted(set(lines) - alone):
            low, high = min(lines[shift])[0], max(lines[shift])[0]
            if before is None or max(low - before[1], before[0] - high) > spec.GAP or shift - before[2] > spec.DRIFT:
                merged.append([])
            merged[-1] += lines[shift]
            before = low, high, shift
        for hits in merged:
            covered = len({i + k for _, i in hits for k in range(3)})
            first, after = min(p for p, _ in hits), max(p for p, _ in hits) + 3
            whole = covered == len(t) if exact else covered >= spec.LEAST * len(t) and covered >= spec.LEAST * (after - first)
            score = max(score, covered / len(t) if whole or not exact else 0.0)
            if whole:
                spans.append((first, after, number, label, exact, (len(t) - covered + max(0, after - first - covered), -covered)))
    found, group, end = [s for s in spans if s[4]], [], 0
    for s in [*sorted(s for s in spans if not s[4]), (1 << 60, 0, 0, "", False, (0, 0))]:
        if s[0] >= end:
            found += [x for x in group if x[5] == min(y[5] for y in group)]
            group = []
        group.append(s)
        end = max(end, s[1])
    return ",".join(sorted({s[3] for s in found})), round(score, 9), tuple(sorted((s[0], s[1] - 1, s[3]) for s in found))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """rows: (id, fingerprint). All pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[find(f)].append(i)
    return [(i, f"{f:016x}", min(least[find(f)], default=None)) for i, f in rows]


def judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOW)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    for kind, pattern, ok in checks:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    counts = [sum(k == kind for k, _, _ in out) for kind, _, _ in checks]
    return (*counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in out)))


def conversation(turns):
    """turns: (turn, role, text) of one conversation."""
    turns = sorted(turns, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    learnt = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), sha(said), len(learnt), sha(learnt)


def discovered(mentions, spec):
    """(value, kind) of the values that patterns find: the graph in dictionaries. mentions: (value, text before)."""
    edges, seeds = set(), {}
    for value, before in mentions:
        tokens = re.findall(r"[^\W\d_]+|[^\s]", re.sub("[0-9]+", "0", before.lower()))[-3:]
        edges |= {(value, f"{k}:{' '.join(tokens[-k:])}") for k in (1, 2, 3) if len(tokens) >= k}
        if re.fullmatch("(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}", value):
            seeds[value] = "secret", 1.0
    members = defaultdict(set)
    for v, p in edges:
        members[p].add(v)
    members = {p: vs for p, vs in members.items() if len(vs) >= spec.LEAST_VALUES}
    known = dict(seeds)
    while True:
        trust = defaultdict(float)
        for p, vs in members.items():
            for v in vs & known.keys():
                trust[p, known[v][0]] += known[v][1] / (len(vs) + 1)
        fresh = {}
        for v in {v for v, _ in edges} - known.keys():
            if len(v) < 6 or not re.search("[0-9@].*[0-9@]", v):
                continue
            clean = defaultdict(lambda: 1.0)
            for (p, kind), t in trust.items():
                if t >= spec.PATTERN and v in members[p]:
                    clean[kind] *= 1 - min(t, 0.999)
            if clean and max((1 - c, k) for k, c in clean.items())[0] >= spec.VALUE:
                confidence, kind = max((1 - c, k) for k, c in clean.items())
                fresh[v] = kind, confidence
        if not fresh:
            return {(v, k) for v, (k, _) in known.items() if v not in seeds}
        known |= fresh


def languages(known, texts, spec):
    """(language, score) of each text, learnt from ``known`` (text, language), n-gram by n-gram."""

    def grams(text):
        line = (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode()
        for n in (2, 3, 4):
            for i in range(len(line) - n + 1):
                code = line[i] * 257 + line[i + 1]
                for c in line[i + 2 : i + n]:
                    code = (code * 16777619 + c) % 2**32
                yield (code * 2654435761 % 2**32) >> 18

    counts = defaultdict(lambda: defaultdict(int))
    for text, lang in known:
        if text and lang and re.search(r"[^\W\d_]", text):
            for g in grams(text):
                counts[lang][g] += 1
    langs = sorted(counts)
    total = [sum(counts[x].values()) + 0.5 * spec.BUCKETS for x in langs]
    share = [[(counts[x][g] + 0.5) / t for g in range(spec.BUCKETS)] for x, t in zip(langs, total, strict=True)]
    code, odds, trust = spec.codewords(len(langs)).tolist(), [], []
    for bit in range(len(code[0])):
        sides = [[i for i in range(len(langs)) if code[i][bit] == s] for s in (1.0, -1.0)]
        odds.append([math.log(sum(share[i][g] for i in sides[0]) / len(sides[0])) - math.log(sum(share[i][g] for i in sides[1]) / len(sides[1])) for g in range(spec.BUCKETS)])
    for i in range(len(langs)):
        row = []
        for bit, o in enumerate(odds):
            mean = sum(p * w for p, w in zip(share[i], o, strict=True))
            spread = math.sqrt(sum(p * w * w for p, w in zip(share[i], o, strict=True)) - mean * mean)
            row.append(max(0.5 * (1 + math.erf(code[i][bit] * mean / spread * math.sqrt(spec.JUDGED) / math.sqrt(2))) - 0.5, 1e-6))
        trust.append([w / sum(row) for w in row])
    out = []
    for text in texts:
        if not text or not re.search(r"[^\W\d_]", text):
            out.append(("und", 0.0))
            continue
        found = list(grams(text))
        margins = [max(-20, min(20, sum(o[g] for g in found) / len(found) * min(len(found), 60))) for o in odds]
        losses = [sum(w * math.exp(-max(-10, min(10, c * m / 2))) for w, c, m in zip(trust[i], code[i], margins, strict=True)) for i in range(len(langs))]
        best = min(range(len(langs)), key=lambda i: losses[i])
        out.append((langs[best], 1 / (losses[best] + 1e-12) / sum(1 / (x + 1e-12) for x in losses)))
    return out


def toxic(text, weights, bias, noise):
    """(score, start and end of the worst sentence) by the noisy-or of sentences, word by word."""
    text, clean, worst = text or "", 1.0, (None, None, None)
    for m in re.finditer(r"[^.!?\n]+", text):
        total, any_weight = bias, False
        for word in set(re.findall(r"[^\W\d_]+", m.group().lower())):
            w = sum(weights.get(f, 0.0) for f in [word, *(word[:n] + "^" for n in (4, 5, 6, 7) if n <= len(word))])
            total, any_weight = total + w, any_weight or w != 0
        if any_weight:
            p = 1 / (1 + math.exp(-max(-30, min(30, total))))
            clean *= 1 - p
            if worst[0] is None or p > worst[0]:
                worst = p, m.start(), m.end()
    return noise + (1 - 2 * noise) * (1 - clean), worst[1], worst[2]


def similar(texts, least=0.8, k=5):
    """The classes of texts, each a frozenset, by all pairs of their k-word shingles."""
    shingles = {}
    for t in set(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        shingles[t] = {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()
    root = {t: t for t in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = list(shingles)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            x, y = shingles[a], shingles[b]
            if (not x and not y) or len(x & y) >= least * len(x | y) > 0:
                root[find(a)] = find(b)
    classes = defaultdict(set)
    for t in shingles:
        classes[find(t)].add(t)
    return {frozenset(c) for c in classes.values()}


def runs(words):
    """All runs (start, end, period) of at least 3 periods and 24 words, every period tried on all words."""
    import numpy as np

    ids = {}
    x, found = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64), {}
    for q in range(1, len(x) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= 2 * q:
                found.setdefault((a, b + q), q)
    return sorted((a, b, q) for (a, b), q in found.items() if b - a >= 24)


def periodic(doc_id, text):
    from fractions import Fraction
    from zlib import crc32

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def negatives(rows, positives=5, negatives=5):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, label, vector), each pair by itself."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and usable(v)]
    anchors = {}
    for i, y, v in rows:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for anchor, (label, vector) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=False)), i, y) for i, y, v in rows if i != anchor)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(anchor, i, rank, j, -s, -t) for rank, (t, j, _) in enumerate(fit, 1)]
    return out

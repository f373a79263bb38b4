"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def raw(t):
    return (t or "").encode()


def lower(t):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(t))


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def substring(docs, n=50):
    first, order = {}, lambda d: 2**63 - 1 if d is None else d
    words = [(d, SPACE.findall(raw(t))) for d, t in docs]
    for d, w in words:
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, 2**64), order(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < order(d):
                gone[k : k + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


def near(docs, k=2):
    sets = []
    for _, t in docs:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(docs)), key=key)


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    found |= windows[x]
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=key)


def rules(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = [x.decode() for x in SPACE.findall(t.encode())]
        lines = [x for x in t.split("\n") if SPACE.search(x.encode())]
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeat = {p for i, x in enumerate(three) if three.count(x) > 1 for p in (i, i + 1, i + 2)}
        out.append(
            (
                d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat),
                len(w) < 50 or 100 * len(repeat) > 50 * len(w)
            )
        )
    return sorted(out, key=key)


def byte_repeats(docs, n=400):
    count = {}
    texts = [(d, raw(t)) for d, t in docs]
    for _, t in texts:
        for k in range(len(t) - n + 1):
            count[t[k : k + n]] = count.get(t[k : k + n], 0) + 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


def quality(url, rule_list):
    if url is None or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1])
    fits = [(len(h + p), h + p, v) for h, p, v in rule_list if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    return host, m[2], *(max(fits)[1:] if fits else (None, None))


def template_tree(rows, opt):
    """{(host, segs): (template, purity, rejected)} of the path-template tree; rows are (host, segments, bad or None)."""
    import math

    def grow(rows):
        """Templates of one host's paths, branch by branch."""
        out = {}

        def walk(paths, level, name):
            done = [p for p in paths if len(p[0]) <= level]
            for p in done:
                out[tuple(p[0])] = name
            kids = {}
            for p in paths:
                if len(p[0]) > level:
                    kids.setdefault(p[0][level], []).append(p)
            labels = lambda ps: [b for _, b in ps if b is not None]
            every = labels([p for k in kids.values() for p in k])
            own = (sum(every) + opt.prior * opt.pull) / (len(every) + opt.pull)
            classes = {}
            for ps in kids.values():
                have = labels(ps)
                share = (sum(have) + opt.pull * own) / (len(have) + opt.pull)
                step = "?" if not have else str(min(opt.bins - 1, math.floor(math.asin(math.sqrt(share)) * 2 * opt.bins / math.pi + 1e-9)))
                classes.setdefault(step, []).extend(ps)
            for step, ps in classes.items():
                walk(ps, level + 1, f"{name}/*{step}")

        walk(rows, 0, "")
        return out

    hosts = {}
    for h, segs, bad in rows:
        hosts.setdefault(h, []).append((segs, bad))
    common_rows = [(s, b) for h, s, b in rows if h]
    common = grow(common_rows)
    count = lambda rows, names: {
        t: (len(x := [b for s, b in rows if names[tuple(s)] == t and b is not None]), sum(x)) for t in set(names.values())
    }
    all_counts = count(common_rows, common)
    out = {}
    for h, own in hosts.items():
        names = grow(own)
        counts = count(own, names)
        for s, _ in own:
            n, b = counts[names[tuple(s)]]
            big_n, big_b = all_counts[common[tuple(s)]] if tuple(s) in common else (0, 0)
            rate = (big_b + opt.prior * opt.strength) / (big_n + opt.strength) if tuple(s) in common else opt.prior
            purity = (b + rate * opt.strength) / (n + opt.strength)
            out[h, tuple(s)] = names[tuple(s)], purity, (n > 0 or big_n >= opt.support) and purity >= opt.purity and h != ""
    return out


def verdicts(docs, limits, common, classes):
    """Whether each (doc_id, text, lang) is kept by the quality rules; classes gives a byte's class, common the words of each language."""
    import math
    from collections import Counter

    listed = {w for ws in common.values() for w in ws}

    def measure(t):
        chars = Counter(classes(c) for c in raw(t))
        words = Counter()
        for w in SPACE.findall(lower(t)):
            w = w[:-1] if len(w) > 1 and w[-1:] in (b".", b",", b";", b":") else w
            w = w.decode(errors="replace")
            words[w if w in listed else None] += 1
        return chars, words

    def distance(p, q):
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 0.0
        out = 0.0
        for k in p.keys() | q.keys():
            a, b = p[k] / n, q[k] / m
            c = (a + b) / 2
            out += sum(x * math.log2(x / c) for x in (a, b) if x > 0)
        return math.sqrt(max(0.0, out / 2))

    def mixed(p, q):
        n, m = sum(p.values()), sum(q.values())
        return Counter({k: p[k] / n + q[k] / m for k in p.keys() | q.keys()})

    base = {i: r[-1] for i, r in enumerate(x for d in docs for x in rules([d[:2]]))}
    language = [d[2] if d[2] in common else None for d in docs]
    found = [measure(d[1]) for d in docs]
    refs = {}
    for i, m in enumerate(found):
        if not base[i]:
            own = refs.setdefault(language[i], (Counter(), Counter()))
            own[0].update(m[0])
            own[1].update(m[1])
    out = []
    for i, (chars, words) in enumerate(found):
        n = sum(words.values())
        if base[i] or n < limits.min_judged:
            out.append(not base[i])
            continue
        own = refs[language[i]]
        best = distance(chars, own[0]), distance(words, own[1])
        for other in refs.values():
            two = distance(chars, mixed(own[0], other[0])), distance(words, mixed(own[1], other[1]))
            best = min(best, two, key=sum)
        out.append(best[0] <= limits.char_distance and best[1] <= limits.word_distance + limits.word_noise / math.sqrt(n))
    return out


def keep_one(docs, k=5):
    """One document of each near-duplicate group: its smallest doc_id."""
    rows = near(docs, k)
    return {d for d, n, c, kept in rows if kept or n == 0}


def strip_words(docs, n=50):
    """The texts without the words of windows that an earlier document has; a text that loses nothing stays as it is."""
    first = {}
    words = [(d, SPACE.findall(raw(t))) for d, t in docs]
    for d, w in words:
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            first[x] = min(first.get(x, 2**64), d)
    out = []
    for (d, t), (_, w) in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone[k : k + n] = [True] * n
        out.append((d, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else t))
    return out

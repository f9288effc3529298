"""Plain Python versions of the training-data operators, for small inputs."""

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def quality(text):
    """Base counts of op7 and the words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = set()
    for i in range(n - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "words": words,
        "lines": lines,
    }


def keeps(text, stop_words) -> bool:
    """The verdict of op7: base rule and threshold table."""
    q = quality(text)
    n, text = q["n_words"], text or ""
    if n < 10 or 100 * q["n_repeat_words"] > 20 * n:
        return False
    lines = len(q["lines"])
    bars = sum(x.count(" | ") >= 3 for x in q["lines"])
    return not (
        q["word_chars"] / n < 2
        or q["word_chars"] / n > 14
        or q["n_symbols"] / n > 0.1
        or text.count("!") / n > 0.5
        or sum(w.lower() in stop_words for w in q["words"]) / n < 0.03
        or q["n_dup_lines"] / lines > 0.5
        or bars / lines > 0.5
    )


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def similar(a, b) -> float:
    common = sum((a & b).values())
    return common / (a.total() + b.total() - common)


def near_classes(texts, similarity=0.8):
    """Index of the first text of each text's class."""
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = bags[i] is None and bags[j] is None and (texts[i] or "") == (texts[j] or "")
            if same or bags[i] and bags[j] and similar(bags[i], bags[j]) >= similarity:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(texts, items, width=13):
    """(n_words, n_hit, item ids, contaminated) of every text."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)


def secrets(text):
    """(start, kind's place, end, value) of the base kinds, in order."""
    out = []
    for k, (kind, pattern) in enumerate(SECRETS):
        for m in pattern.finditer(text or ""):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= (8, 16, 32)[k]:
                out.append((m.start(), k, m.end(), value))
    return sorted(out)


def span_text(spans) -> str:
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b, _ in spans)

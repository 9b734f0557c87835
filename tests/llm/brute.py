"""Plain versions of the operators, to compare with."""

import collections
import hashlib
import re

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def repeated_lines(docs, distance, min_chars, measure=lambda a, b, limit: edits(a, b)):
    """{id: numbers of the lines that repeat an earlier one}, for documents with an id."""
    lines = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in docs if i is not None for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_chars]
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(x, (i, k))
    best = dict(first)
    texts = sorted(first, key=len)
    for n, a in enumerate(texts):
        for b in texts[n + 1 :]:
            if len(b) - len(a) > distance:
                break
            if measure(a, b, distance) <= distance:
                best[a], best[b] = min(best[a], first[b]), min(best[b], first[a])
    out = collections.defaultdict(list)
    for i, k, x in lines:
        if (i, k) > best[x]:
            out[i].append(k)
    return out


def line_distance(measure):
    """The measure where the shorter line allows the edits: two from 24 code points on, one from 12, else none."""

    def far(a, b, limit):
        few = min(2, min(len(a), len(b)) // 12)
        return far if (far := measure(a, b, few)) <= few else limit + 1

    return far


def covered_words(docs, window=50):
    """{id: flags of the words in windows that start in a document with a smaller id}, in the order of ids."""
    first, out = {}, {}
    for i, text in sorted(docs):
        words = WORD.findall(text or "")
        flags = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), i) < i:
                flags[k : k + window] = [True] * window
        out[i] = words, flags
    return out


def near_duplicates(docs):
    """{position: (shingles, component id)}."""
    sets = []
    for _, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) > 4 else [tuple(words)] * bool(words)
        sets.append(set(grams))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min([y for y in (least.get(r), i) if y is not None], default=None)
    return [(len(s), least[find(k)]) for k, s in enumerate(sets)]


def leaks(docs, items):
    """[(words, hit flags, item ids)]."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for i, text in items:
        words = word.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows[tuple(words[k : k + n])].add(i)
    out = []
    for _, text in docs:
        words = word.findall((text or "").translate(LOWER))
        flags, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[k : k + n])):
                    found |= ids
                    flags[k : k + n] = [True] * n
        out.append((words, flags, found))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                luhn = sum(sum(divmod(d * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out

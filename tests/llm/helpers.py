"""Small fixtures and brute-force versions for the operators of tidelog.llm."""

import collections
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def numbered(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


#: Nulls, empty, white space only, ties, repeated rows, long runs, letters beyond ASCII, null ids.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. Idiot!"),
    (2, "the  quick brown\tfox jumps over the lazy dog. Idiot!"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "x" * 5000 + "1" * 5000 + "@" * 50),
    (7, numbered("w", 120)),
    (8, numbered("w", 120) + " tail"),
    (9, "head " + numbered("w", 60)),
    (10, "Éa ñandú größer 日本語 ​ ½ 12.5% <|endoftext|> <s>"),
    (11, "one two"),
    (11, "one two"),
    (12, "ONE two"),
    (13, numbered("q", 9) + " lone"),
    (None, "a row without an id"),
    (None, numbered("w", 120)),
    (14, numbered("v", 3000)),
]


def frame(spark, rows=TEXTS, extra=True):
    """documents with columns whose names clash with those that operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(i, t, "en", "src0", 7, 1, "z", 2.5) for i, t in rows], "doc_id long, text string, lang string, source string, n int, normal long, _digest string, key double")


def links(texts):
    """doc -> (set size, smallest linked doc), by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_words(texts, width=50):
    """doc -> words that stay, by looking at every window of every text."""
    words = {i: WORD.findall(t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    kept = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept[i] = [x for k, x in enumerate(w) if k not in gone]
    return words, kept


def counted(texts):
    return collections.Counter(x for _, t in texts for x in [*WORD.findall((t or "").translate(LOWER)), None])

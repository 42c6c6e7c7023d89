"""A small corpus with awkward rows, and plain-Python versions of the operators' contracts."""

import random
import re

WORDS = [a + b for a in ("th", "re", "on", "ing", "ér", "sch") for b in ("an", "or", "ti", "ea", "ouß")]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, row int, "
          "start int, score double, pos int, rule string")


def prose(rng, n):
    out = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+) ", "\\1.\n", " ".join(out))


def texts(seed=1):
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 90)
    words = base.split()
    out = [None, "", " \n\t ", "One", "two words", "a " * 70, "Ünï x\x1cy \x0b z", base, base, base.upper()]
    out += [" ".join(w if i != k else "changed" for i, w in enumerate(words)) for k in (3, 40, 88)]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 25) for _ in range(4)]
    out += [prose(rng, n) for n in (4, 5, 19, 20, 21, 200)]
    out += [prose(rng, 12_000), passage + "\n" + passage, "x" * 5_000, "<|endoftext|> <|ENDOFTEXT|> don't ## a##"]
    return out


def rows(seed=1):
    """Documents with clashing extra columns; one row has no id."""
    got = [(i * 3, t, "en", "s", None if t is None else len(t), 1, 2, "k", 3, 4, 0.5, 6, "r") for i, t in enumerate(texts(seed))]
    return got + [(None, "a text without an id", None, None, 20, *[None] * 8)]


def frame(spark, some=None, parts=5):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(parts)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def shingles(text, n=5):
    w = space_words(ascii_lower(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, percent=75):
    """doc_id -> least doc_id reachable by links."""
    sets = {i: shingles(t) for i, t in docs}
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    return best


def covered(docs, n=20):
    """doc_id -> set of word positions inside a window that starts earlier."""
    first, out = {}, {i: set() for i, _ in docs}
    for i, t in sorted(docs):
        w = space_words(t)
        for s in range(len(w) - n + 1):
            if tuple(w[s:s + n]) in first:
                out[i].update(range(s, s + n))
            else:
                first[tuple(w[s:s + n])] = (i, s)
    return out

"""Plain versions of the operators, row by row, for tests."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np

from sievelight.llm import bpe, langid, linededup, mixing, simhash


def words_of(line):
    """The set of words of a line: runs of ASCII letters and digits and of all beyond ASCII, in lower case."""
    return frozenset(re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", line.lower()))


def forest(pairs):
    """The least member of the group of each node that isn't the least."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def log_likelihood(word, p, ids, longest):
    """Of a marked word, all its segmentations summed in the log domain."""
    f = [0.0] + [-math.inf] * len(word)
    for e in range(1, len(word) + 1):
        parts = [f[e - 1] + math.log(langid._UNKNOWN)]
        parts += [f[s] + math.log(p[ids[word[s:e]]]) for s in range(max(0, e - longest), e) if word[s:e] in ids and p[ids[word[s:e]]] > 0]
        top = max(parts)
        f[e] = top + math.log(sum(math.exp(x - top) for x in parts))
    return f[-1]


def language(text, model):
    """The language of a text, or none."""
    lat = langid.lattice()
    ids = {x: i for i, x in enumerate(lat.pieces)}
    # Words that count are those without digits
    words = [w for w in re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower()) if not re.search("[0-9]", w)]
    chars = sum(map(len, words))
    if not chars or not model["langs"]:
        return None
    total = [sum(log_likelihood(langid._MARK + w, model["p"][:, k], ids, lat.longest) for w in words) for k in range(len(model["langs"]))]
    k = int(np.argmax(total))
    least = model["mean"][k] - langid.REJECT * model["sd"][k] * max(1 / math.sqrt(chars), 0.25)
    return model["langs"][k] if total[k] / chars >= least - 1e-9 else None


def matches(docs):
    """{(id, line): the first earlier line that matches} of texts by id."""
    lines = [(d, n, s) for d, t in sorted((k, v) for k, v in docs.items() if k is not None) for n, x in enumerate((t or "").split("\n")) if (s := words_of(x))]
    out = {}
    for i, (d, n, s) in enumerate(lines):
        for e, m, r in lines[:i]:
            if len(s & r) / len(s | r) >= linededup.THRESHOLD - 1e-9:
                out[d, n] = e, m
                break
    return out


def without_lines(docs):
    """Texts by id that have another line left, without the lines that match."""
    gone = matches(docs)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if (d, n) not in gone]
        if len(left) == len(lines):
            out[d] = t
        elif any(words_of(x) for x in left):
            out[d] = "\n".join(left)
    return out


def near_groups(signed):
    """Of (id, signature bytes, words) all pairs, as groups."""
    rows = [(i, np.unpackbits(np.frombuffer(s, np.uint8)), n) for i, s, n in signed]
    return forest([(a, b) for a, s, m in rows for b, t, n in rows if a < b and (s != t).sum() <= simhash.DISTANCE and 2 * min(m, n) >= max(m, n)])


def mixture(rows, weights=None, other=mixing.OTHER, seed=mixing.SEED):
    """{id: copies} of (id, source, size) with distinct ids."""
    weights = mixing.WEIGHTS if weights is None else weights
    chars = defaultdict(int)
    for _, s, n in rows:
        chars[s or ""] += max(n or 0, 0)
    weight = {s: weights.get(s, other) for s in chars if chars[s] > 0 and weights.get(s, other) > 0}
    out = defaultdict(int)
    for s, w in weight.items():
        rate = math.floor(float(w) * float(sum(chars[x] for x in weight)) * float(mixing.ONE) / (float(sum(weight.values())) * float(chars[s])))
        at = int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:8], 16) % mixing.ONE
        own = [i for i, x, _ in rows if (x or "") == s]
        for i in sorted(own, key=lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), str(i))):
            out[i] += (at + rate) // mixing.ONE - at // mixing.ONE
            at += rate
    return {i: n for i, n in out.items() if n}


def plain_bpe():
    """The public implementation over the same ranks and pattern."""
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(r) for a, r in (line.split() for line in open(bpe.RANKS, "rb") if line.strip())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})

"""Plain, slow versions of the corpus operators, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def raw_words(text):
    return SPLIT.findall((text or "").encode())


def token_counts(rows):
    import public_tokenizers
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows}


def pieces(rows, capacity=4096):
    import public_tokenizers
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = set()
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at:at + capacity], dtype="<u4")
            out.add((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    return out


def repeats(rows, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first, words = {}, {i: raw_words(t) for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at:at + window]), i)
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < i:
                gone[at:at + window] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def simhash(text):
    import xxhash
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw_words(text)]
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(prints, most=3):
    """doc_id -> smallest doc_id reachable over links of at most ``most`` bits."""
    ids = sorted(prints)
    a = np.array([prints[i] for i in ids], dtype=np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= most) for x in a]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = new


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256) of one text."""
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace(
        "(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")), lambda m: len(m[2]) >= 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, good) in enumerate(kinds) for m in pattern.finditer(text or "") if good(m)]
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))
    return (*(sum(f[3] == kind for f in found) for kind in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest())

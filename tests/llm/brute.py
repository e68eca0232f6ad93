"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def packed_faults(pieces, ids_of, length=2048):
    """What is wrong with the pieces of a packing: rows with the contract's columns; ids_of: doc_id -> ids."""
    import zlib

    import numpy as np

    at, seqs, wrong = Counter(), {}, []
    for p in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        ids = ids_of[p["doc_id"]]
        if p["start"] != at[p["doc_id"]] or p["doc_tokens"] != len(ids) or p["length"] <= 0:
            wrong.append(("piece", p))
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
        if zlib.crc32(part.tobytes()) != p["ids_crc32"]:
            wrong.append(("crc", p))
        at[p["doc_id"]] += p["length"]
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    wrong += [("missing", d) for d, ids in ids_of.items() if at[d] != len(ids)]
    for k, spans in seqs.items():
        end = 0
        for o, n in sorted(spans):
            if o != end:
                wrong.append(("gap", k, o, end))
            end = o + n
        if end > length or (end < length and k != max(seqs)):
            wrong.append(("fill", k, end))
    return wrong


def substring(rows, window=20):
    """doc_id -> (n_words, n_removed, kept_sha256) of op 10, over (doc_id, text) rows with different ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        ws = WORD.findall(text or "")
        gone = set()
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        out[d] = (len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def byte_repeats(rows, window=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) of op 7, over (doc_id, text) rows with different ids."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if seen.setdefault(k, d) != d:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def jaccard(rows, shingle=4, percent=85):
    """doc_id -> (n_shingles, component_id) of op 5, over (doc_id, text) rows with different ids."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, by, root = {}, {}, {}
    for d, text in sorted(rows):
        ws = WORD.findall((text or "").translate(low))
        sets[d] = {tuple(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))} if ws else set()
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        n = Counter(e for t in s for e in by.get(t, ()))
        for e, both in n.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for t in s:
            by.setdefault(t, []).append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}

"""Plain versions of the operators that SQL cannot express."""

import hashlib


def without_repeats(rows, length=100):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} of (id, text) rows in id order."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            else:
                seen.add(window)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def linked_documents(rows, width=3, percent=90):
    """{id: (n_shingles, component)} of (id, text) rows with different ids."""
    sets, holders = {}, {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        found = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        sets[key] = found
        for shingle in found:
            holders.setdefault(shingle, []).append(key)
    parent = {key: key for key in sets}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for key, found in sets.items():
        shared = {}
        for shingle in found:
            for other in holders[shingle]:
                if other < key:
                    shared[other] = shared.get(other, 0) + 1
        for other, same in shared.items():
            if 100 * same >= percent * (len(found) + len(sets[other]) - same):
                a, b = sorted((root(key), root(other)))
                parent[b] = a
    return {key: (len(found), root(key)) for key, found in sets.items()}

"""Plain near-duplicate groups for comparison."""

import re

import xxhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(texts):
    """Sets of ids whose fingerprints are connected by at most three bits."""
    prints = {k: fingerprint(t) for k, t in texts.items()}
    left, out = set(texts), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            k = todo.pop()
            group.add(k)
            near = {j for j in left if bin(prints[k] ^ prints[j]).count("1") <= 3}
            left -= near
            todo += near
        out.append(group)
    return out

"""Plain re-statements of the contracts, row by row, to compare the queries with."""

import hashlib
import re
import zlib

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def media_row(text):
    raw = (text or "").encode()
    pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(pay), sha(pay), zlib.crc32(pay[-32:])


def words(text):
    return SPACE_WORD.findall((text or ""))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACE_WORD.findall(ascii_lower(text))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())


def dedup(rows):
    """{doc_id: (n_shingles, component)} by comparing every pair."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        x = sets[ids[a]]
        for b in range(a + 1, len(ids)):
            y = sets[ids[b]]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = find(ids[a]), find(ids[b])
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def water(sizes: dict, weights=(5, 2, 1), epochs=3):
    """Targets by repeated clamping."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > epochs * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in rest}
        fixed |= {s: float(epochs * sizes[s]) for s in over}


ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_row(text, templates, step=64, threshold=0.8):
    """(n_words, places, base labels, labels, score) by trying every template on every block."""
    w = ALNUM_WORD.findall(ascii_lower(text))
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        n = len(t.words)
        if t.exact:
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == t.words]
            places += at
            base |= {t.label} if at else set()
            continue
        own = step * -(-n // step)
        for b in range(0, len(w), own):
            share = len(set(t.words) & set(w[b : b + 2 * own])) / len(set(t.words))
            if share >= threshold - 1e-12:
                labels.add(t.label)
                score = max(score, share)
    return len(w), sorted(places), sorted(base), sorted(base | labels), 1.0 if base else score

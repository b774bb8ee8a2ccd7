"""Plain Python forms of the operators, for comparison on small tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def context_tree(rows, depth=4, folds=10):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base, score)."""
    texts = {d: (t or "").translate(LOWER) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % folds == 0 for d in texts}
    tokens = {d: [*WORDS.findall(t), None] for d, t in texts.items()}
    c = Counter(w for d in texts if not held[d] for w in tokens[d])
    total, distinct = sum(c.values()), len(c)
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        data = bytes(depth) + text.encode()
        for i in range(len(data) - depth):
            node = 1
            for k in range(8):
                bit = data[i + depth] >> (7 - k) & 1
                yield data[i : i + depth], node, bit
                node = 2 * node + bit

    for d, t in texts.items():
        if not held[d]:
            for context, node, bit in steps(t):
                for k in range(depth + 1):
                    counts[context[depth - k :], node][bit] += 1
    below, stop = defaultdict(float), {}
    for length in range(depth, -1, -1):
        for key in [k for k in counts if len(k[0]) == length]:
            a, b = counts[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            mixed = own
            if length < depth:
                top = max(own, below[key])
                mixed = top + math.log((math.exp(own - top) + math.exp(below[key] - top)) / 2)
                stop[key] = math.exp(own - mixed) / 2
            if length:
                below[key[0][1:], key[1]] += mixed
    out = {}
    for d, t in texts.items():
        score = 0.0
        for context, node, bit in steps(t):
            said, rest = 0.0, 1.0
            for k in range(depth + 1):
                key = context[depth - k :], node
                a, b = counts.get(key, (0, 0))
                s = stop.get(key, 0.5) if k < depth else 1.0
                said, rest = said + rest * s * (b + 0.5) / (a + b + 1), rest * (1 - s)
            score += math.log10(said if bit else 1 - said)
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[d])
        out[d] = held[d], len(tokens[d]), sum(c[w] > 0 for w in tokens[d]), total, base, score
    return out


def near_duplicates(rows, size=5, num=80, den=100):
    """doc_id -> (n_shingles, component_id, n_links)."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


def base_quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def license_places(text):
    """(n_words, sorted starts, base labels)."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), sorted(i for i, _ in found), ",".join(sorted({x for _, x in found}))


def damage(rows):
    """[(conv_id, turn, role, text)] after the damage, repeats adjacent."""
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def repair(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, [(role, text)]) by suffix recursion."""
    from functools import lru_cache

    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = {}
    for conv, turns in groups.items():
        # equal turns: by role, then text; callers avoid ties that a digest orders otherwise
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            end = WORDS.findall(text)
            if not end:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if end[-1][-1] in ".!?" else "truncated")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, shape):
            """Lightest (cost, audit, turns) from row i on, `shape` being the initials so far ('' , 's', 'u', 'a': the last)."""
            found = []
            if i == len(turns):
                if shape in ("", "a"):
                    return 0, "", ()
                c, a, t = best(i, "a" if shape == "u" else "u")
                return c + 2, "I" + a, (("assistant" if shape == "u" else "user", ""), *t)
            _, role, text = turns[i]
            c, a, t = best(i + 1, shape)
            found.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                new, name = ("a", "assistant") if shape == "u" else ("u", "user")
                c, a, t = best(i + 1, new)
                found.append((c + 2 + extra, "R" + a, ((name, text), *t)))
                if (shape, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, a, t = best(i + 1, role[:1])
                    found.append((c + extra, "K" + a, ((role, text), *t)))
                # one or two inserts before this row; more never help
                c2 = []
                step, shape2 = (), shape
                for k in (1, 2):
                    nxt, nm = ("a", "assistant") if shape2 == "u" else ("u", "user")
                    step, shape2 = (*step, (nm, "")), nxt
                    if (shape2, role[:1]) in {("u", "a"), ("a", "u")}:
                        c, a, t = best(i + 1, role[:1])
                        c2.append((c + 2 * k + extra, "I" * k + "K" + a, (*step, (role, text), *t)))
                    nxt, nm = ("a", "assistant") if shape2 == "u" else ("u", "user")
                    c, a, t = best(i + 1, nxt)
                    c2.append((c + 2 * k + 2 + extra, "I" * k + "R" + a, (*step, (nm, text), *t)))
                    c, a, t = best(i + 1, shape2)
                    c2.append((c + 2 * k + 3, "I" * k + "D" + a, (*step, *t)))
                found += c2
            return min(found)

        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best(0, "")
        best.cache_clear()
    return out


def spelled(text, byte_tokenizer, piece_tokenizer):
    """Tokens (id, bytes) of both sides; empty lists where they do not spell the text."""
    if not text:
        return [], []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        back[chr(256 + k)] = b
    e = byte_tokenizer.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(back[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
         for i, p in ((i, piece_tokenizer.id_to_piece(i)) for i in piece_tokenizer.encode(text))]
    want = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == want == b"".join(t for _, t in b) else ([], [])


def alignments(rows, byte_tokenizer, piece_tokenizer):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] byte by byte."""
    found = []
    for d, text in rows:
        a, b = spelled(text, byte_tokenizer, piece_tokenizer)
        at_a, at_b = ([k for k, (_, t) in enumerate(side) for _ in t] for side in (a, b))
        links = sorted(set(zip(at_a, at_b)))
        ends = set(itertools.accumulate(len(t) for _, t in a)) & set(itertools.accumulate(len(t) for _, t in b))
        groups, start = [], 0
        for end in sorted(ends):
            groups.append("|".join(",".join(str(side[k][0]) for k in sorted(set(at[start:end]))) for side, at in ((a, at_a), (b, at_b))))
            start = end
        found.append((d, a, b, groups, [(a[i][0], b[j][0]) for i, j in links]))
    counts = Counter(p for *_, links in found for p in links)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(d, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(g)) for d, a, b, g, links in found]


def personal(text):
    """[(start, end, kind)] of the base patterns by plain expressions."""
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(patterns) for m in re.finditer(p, text) if good(m.group())]
    return [(a, b, name) for a, _, b, name in sorted(found)]

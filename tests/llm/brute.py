"""Plain versions of the operators' contracts, for comparison on small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs, items):
    """docs, items: lists of (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    names |= {str(x) for x in windows[w] if x is not None}
        out.append((doc, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def op2(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        a = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        b = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        c = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        spans = sorted(a + b + c, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        out.append((doc, len(a), len(b), len(c), sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))))
    return out


def op4(docs, file):
    import struct

    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(file), 0, []
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def fingerprint(text):
    words = VISIBLE.findall(lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(names, links):
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def op5(docs):
    prints = {d: fingerprint(t) for d, t in docs}
    ids = sorted(prints)
    near = components(ids, ((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3))
    return [(d, f"{prints[d]:016x}", near[d]) for d in ids]


def op6(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = VISIBLE.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeat = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if VISIBLE.search(x)]
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed))
    return out


def op7(docs, size=400):
    """docs: (id, text, lang). (id, held out, language, score); every learnable row is learned from."""

    def grams(text):
        words, word = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                word += c.lower() if len(c.lower()) == 1 else c
            elif word:
                words.append(word)
                word = ""
        line = "\0" + "".join(w + "\0" for w in words) if words else ""
        pieces = [c for c in line if c != "\0"] + [line[i : i + 2] for i in range(len(line) - 1)] + [line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != "\0"]
        return Counter(pieces)

    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]
    held = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1
    learned = defaultdict(Counter)
    for doc, text, lang in docs:
        if not held(doc) and lang is not None and text is not None:
            learned[lang] += grams(text)
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in learned.items()}
    out = []
    for doc, text, _ in docs:
        best = ranked(grams(text))
        if not best or not profiles:
            out.append((doc, held(doc), "und", 0.0))
            continue
        far = {lang: sum(abs(ranks[g] - i) if g in ranks else size for i, g in enumerate(best)) for lang, ranks in profiles.items()}
        lang = min(sorted(far), key=far.get)
        out.append((doc, held(doc), lang, 1 - far[lang] / (size * len(best))))
    return out


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op8(docs):
    """doc_id, n_words, n_base, first_word, last_word, base_labels."""
    out = []
    for doc, text in docs:
        words, places = WORD.findall(lower(text)), []
        for phrase, label in PHRASES.items():
            want = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
        starts = [i for i, _ in places]
        out.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def op9(docs, size=200):
    at = Counter()
    for _, text in docs:
        data = (text or "").encode()
        at.update(data[i : i + size] for i in range(len(data) - size + 1))
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            if at[data[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, sha(bytes(b for b, x in zip(data, gone, strict=True) if not x))))
    return out


def near_copies(docs, width=5, least=0.8):
    """The least doc_id of each component of documents whose word shingles have this Jaccard similarity."""
    sets = {}
    for name, text in docs:
        words = lower(text).split()
        sets[name] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    alike = lambda x, y: x == y or len(x & y) >= least * len(x | y)
    found = components(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    return set(found.values())


def mixture(docs, closing=0.5, block_docs=500, seed=7):
    """docs: (id, text, source). (id, source, tokens, epoch, block, position) of every time a document is taken."""
    md5 = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    rows = defaultdict(list)
    for doc, text, source in docs:
        rows[source or ""].append((md5(seed, "" if doc is None else doc), len(VISIBLE.findall(text or "")), doc))
    tokens = {s: sum(n for _, n, _ in r) for s, r in sorted(rows.items())}
    total = sum(tokens.values())

    def shares(tau):
        raised = {s: (n / total) ** tau for s, n in tokens.items() if n}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    spread = lambda p: -sum(x * math.log(x) for x in p.values())
    low, high = 0.0, 1.0  # the entropy falls as tau grows
    aim = spread(shares(1)) + closing * (math.log(len(shares(1))) - spread(shares(1))) if total else 0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if total and spread(shares(middle)) >= aim else (low, middle)
    out = []
    for source, mine in rows.items():
        n_blocks = max(1, -(-len(mine) // block_docs))
        blocks = defaultdict(list)
        for row in sorted(mine, key=lambda r: r[:2]):
            blocks[int(row[0][:8], 16) % n_blocks].append(row)
        passes, left = divmod(round(shares(low)[source] * total), tokens[source]) if tokens[source] else (1, 0)
        for epoch in range(passes + (left > 0)):
            order = sorted(blocks, key=lambda b, e=epoch: (md5(seed, source, e, b), b))
            line = [(b, i, *row) for b in order for i, row in enumerate(blocks[b])]
            for at, (b, i, _, n, doc) in enumerate(line):
                if epoch == passes and (n > left or not left and not i):
                    break
                left -= n if epoch == passes else 0
                out.append((doc, source, n, epoch, b, at))
    return out

"""Plain single-machine versions of the operators, for small tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def top_k(rows, k=10):
    """rows: (vec_id, vector) -> sorted (query_id, rank, vec_id, score)."""
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def ppm(docs, order=5):
    """(doc_id, text) rows -> list of (held_out, n_tokens, n_known, train_tokens, base, score)."""
    tok = lambda t: words(low(t)) + ["\n"]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in docs]
    train = Counter(w for (_, t), h in zip(docs, held) if not h for w in tok(t))
    n, v = sum(train.values()), len(train)
    norm = lambda t: b"\n" * order + " ".join(words(low(t))).encode() + b"\n"
    trie = defaultdict(Counter)
    for (_, t), h in zip(docs, held):
        x = norm(t)
        for j in range(order, len(x)) if not h else ():
            for k in range(order + 1):
                trie[x[j - k:j]][x[j]] += 1

    def score(t):
        x, total = norm(t), 0.0
        for j in range(order, len(x)):
            gone = set()
            for k in range(order, -1, -1):
                c = trie.get(x[j - k:j])
                if not c:
                    continue
                room, fresh = sum(m for s, m in c.items() if s not in gone), sum(s not in gone for s in c)
                if x[j] in c:
                    total += math.log10((c[x[j]] - 0.5) / room)
                    break
                if fresh:
                    total += math.log10(fresh / 2 / room)
                gone |= set(c)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return [(h, len(tok(t)), sum(train[w] > 0 for w in tok(t)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tok(t)), score(t))
            for (_, t), h in zip(docs, held)]


def sentencepiece_rows(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for t in texts:
        ids = sp.encode(t or "")
        out.append((len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    return out


def token_rows(texts):
    """In table order: (start, n_tokens, crc32)."""
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def repeats(texts, length=400, least_words=0):
    """(n_bytes, n_removed, n_spans, kept bytes) of every text; runs of fewer words stay."""
    raw, seen, out = [(t or "").encode() for t in texts], Counter(), []
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p:p + length]] += 1
    for b in raw:
        gone, last = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                for q in range(max(p, last), p + length):
                    gone[q] = 1
                last = p + length
        for m in re.finditer(b"\1+", bytes(gone)) if least_words else ():
            if len(b[m.start():m.end()].split()) < least_words:
                gone[m.start():m.end()] = bytes(m.end() - m.start())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def simhash(text):
    w = words(low(text))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def groups(fps, reach=2):
    """Index of each fingerprint's group."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= reach:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def article(source):
    """Text of the test pages' <article>: blocks are p and headings, br is a space."""
    m = re.search(r"<article>(.*?)</article>", source or "", re.S)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n".join(b for b in blocks if b)


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """{source: size} -> {source: target}, clamping in turns."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: most * sizes[s] for s in names}
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def importance(docs, target, longest=1, buckets=10_000, seed=2024, percent=10, least=20):
    """(doc_id, text) rows and texts -> (doc_id, n_features, weight, score, rank) in row order; equal rows may swap ranks."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    features = lambda w: [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    lists = [features(split(t)) for _, t in docs]
    s, t = Counter(at(f) for x in lists for f in x), Counter(at(f) for x in target for f in features(split(x)))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in set(s) | set(t)}
    weights = [sum(gains[at(f)] for f in x) for x in lists]
    named = ["null" if i is None else str(i) for i, _ in docs]
    hs = [int(hashlib.sha256(f"{seed}:{n}".encode()).hexdigest()[:8], 16) for n in named]
    scores = [w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for w, h in zip(weights, hs)]
    pool = sorted((j for j, (_, x) in enumerate(docs) if len(split(x)) >= least),
                  key=lambda j: (-scores[j], docs[j][0] is None, docs[j][0] or 0))
    rank = {j: r + 1 for r, j in enumerate(pool[:percent * len(pool) // 100])}
    return [(i, len(x), w, sc, rank.get(j)) for j, ((i, _), x, w, sc) in enumerate(zip(docs, lists, weights, scores))]


def exact(docs):
    """(doc_id, text) rows -> (doc_id, keep_id, group_size, kept, text_sha256) in row order."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    members = defaultdict(list)
    for j, n in enumerate(norm):
        members[n].append(j)
    first = {n: min(m, key=lambda j: (-len(docs[j][1] or ""), docs[j][0] is None, docs[j][0] or 0, j)) for n, m in members.items()}
    return [(i, docs[first[n]][0], len(members[n]), first[n] == j, hashlib.sha256(n.encode()).hexdigest())
            for j, ((i, _), n) in enumerate(zip(docs, norm))]


def merkle(rows, arity=2):
    """(doc_id, source, lang, n_chars, text) rows -> the query's rows, in no order."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def up(levels, at, node):
        """(siblings, root) of a leaf that is ``node`` instead."""
        around = ""
        for nodes in levels[:-1]:
            run = nodes[at - at % arity:at - at % arity + arity]
            k = at % arity
            around += "".join(run[:k] + run[k + 1:])
            node = sha("".join(run[:k] + [node] + run[k + 1:]))
            at //= arity
        return around, node

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, sha("".join(map(cell, r)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([x[1] for x in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (r, leaf) in enumerate(groups[g]):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low_proof, node = up(trees[g], at, sha("".join(map(cell, (*r[:3], r[3] + 1, r[4])))) if hit else leaf)
            high_proof, root = up(top, k, node)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha(low_proof + high_proof), root, root == top[-1][0]))
    return out

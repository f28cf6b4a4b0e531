"""Plain versions of the corpus operators, for comparison on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return WORDS.findall(ascii_lower(t or ""))


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for i, t in docs:
        g = groups[t or ""]
        known = [x for x in g if x is not None]
        keep = max(known) if known else None
        out.append({"doc_id": i, "keep_id": keep, "group_size": len(g), "kept": i == keep, "text_sha256": sha(t or "")})
    return out


def secrets(docs):
    out = []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = sorted(found)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{24,}", t):
            s = m[0]
            if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                continue
            if re.search(r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0123456|abcdefg|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", s):
                continue
            k, bits = next(x for x in ((3, 3.05), (4, 3.87), (5, 3.87)) if re.fullmatch({3: "[0-9a-fA-F]+", 4: "[0-9A-Za-z]+", 5: "[0-9A-Za-z+/_=-]+"}[x[0]], s))
            if max(-sum(c / 24 * math.log2(c / 24) for c in Counter(s[j : j + 24]).values()) for j in range(len(s) - 23)) >= bits:
                found.append((m.start(), k, m.end(), ("entropy_hex", "entropy_alnum", "entropy_base64")[k - 3]))
        text = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, e, k in xs)
        n = Counter(k for *_, k in base)
        out.append({"doc_id": i, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": sha(text(base)), "spans": text(sorted(found))})
    return out


def decontaminate(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(i)
    lengths = sorted({len(w) for w in windows})
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= found
        out.append({"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(ids), "items_sha256": sha(",".join(sorted(map(str, ids)))), "contaminated": bool(hit)})
    return out


def urls(pages):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    out = []
    for i, u in pages:
        host = path = ""
        if "://" in (u or ""):
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = ascii_lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append({"page_id": i, "host": host, "path": path, "rule": best and best[1], "verdict": best and best[2]})
    return out


def licenses(docs):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    out = []
    for i, t in docs:
        w = words(t)
        places = [(s, k) for k, p in phrases.items() for s in range(len(w)) if w[s : s + len(p)] == p]
        at = [s for s, _ in places]
        out.append({"doc_id": i, "n_words": len(w), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted({k for _, k in places}))})
    return out


def check_packing(docs, rows, capacity=2048):
    """Asserts a complete packing; returns the number of sequences."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes())), (i, r)
            assert r["length"] == capacity or k == 0 and 0 < r["length"] <= capacity
            at += r["length"]
        assert at == len(ids)
        assert len(by_doc[i]) == -(-len(ids) // capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def shingle_sets(docs, k=5):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        out[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    return out


def links(docs):
    """Linked pairs of documents with their sizes of intersection and union."""
    sets, by = shingle_sets(docs), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter()
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                both[min(own[a], own[b]), max(own[a], own[b])] += 1
    return {p: n for p, n in both.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}, sets, both


def near(docs):
    found, sets, _ = links(docs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [{"doc_id": i, "n_shingles": len(s), "component_id": find(i), "kept": find(i) == i} for i, s in sets.items()]


def repeats(docs, size=400):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, d in data:
        seen.update(hash(d[p : p + size]) for p in range(len(d) - size + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        upto = 0
        for p in range(len(d) - size + 1):
            if seen[hash(d[p : p + size])] > 1:
                for b in range(max(p, upto), p + size):
                    gone[b] = 1
                upto = p + size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append({"doc_id": i, "n_bytes": len(d), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": sha(kept)})
    return out


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def quality(rows, labels, halves, ridge=0.05, width=8.0):
    """Scores by id (a list, for ids that several rows share): one dense ridge, isotonic steps by their min-max formula."""
    import numpy as np

    from logweir.llm.quality import BINS, _Map, statistics

    marks = defaultdict(list)
    for i, y in labels:
        if y is not None:
            marks[i].append(y)
    x = {k: np.array(statistics(t or "")) for k, (_, t) in enumerate(rows)}
    known = [k for k, (i, _) in enumerate(rows) if i in marks and crc(i) % 4 != 2]
    y = np.array([np.mean(marks[rows[k][0]]) for k in known])
    all_x = np.stack([x[k] for k in known])
    features = _Map(all_x.mean(axis=0), all_x.std(axis=0), width)
    z = features(all_x)
    half = np.array([halves[rows[k][0]] for k in known])

    def fit(keep):
        penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
        return np.linalg.solve(z[keep].T @ z[keep] + penalty, z[keep].T @ y[keep])

    cross = [fit(half == 1), fit(half == 0)]
    raw = np.array([z[k] @ cross[half[k]] for k in range(len(z))])
    at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
    bins = sorted(set(at.tolist()))
    n, s = [int((at == b).sum()) for b in bins], [float(y[at == b].sum()) for b in bins]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    level = [max(min(mean(a, b) for b in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    xs, ys = [], []
    for v in sorted(set(round(v, 12) for v in level)):
        own = [k for k in range(len(bins)) if round(level[k], 12) == v]
        xs.append(sum(n[k] * ((bins[k] + 0.5) / BINS * 2 - 0.5) for k in own) / sum(n[k] for k in own))
        ys.append(v)
    whole, out = fit(half >= 0), defaultdict(list)
    for k, (i, _) in enumerate(rows):
        r = float((features(x[k][None, :]) @ whole)[0])
        out[i].append(float(np.clip(0.98 * np.interp(r, xs, ys) + 0.02 * min(1, max(0, r)), 0, 1)))
    return out


def languages(rows, penalty=4.0, steps=10):
    """(language, share) by id: counts in dictionaries, every set size tried."""
    from logweir.llm.language import BUCKETS, trigram_counts

    def counts(text):
        _, bucket, n = trigram_counts([text])
        return dict(zip(bucket.tolist(), n.tolist(), strict=True))

    model = defaultdict(Counter)
    for i, t, lang in rows:
        if t is not None and lang is not None and crc(i) % 5 != 0:
            model[lang].update(counts(t))
    langs = sorted(model)
    chance = lambda k, b: (model[k][b] + 0.5) / (sum(model[k].values()) + 0.5 * BUCKETS)

    def em(own, share, times):
        p = {b: [chance(k, b) for k in langs] for b in own}
        for _ in range(times):
            got = [0.0] * len(langs)
            for b, n in own.items():
                whole = sum(x * y for x, y in zip(p[b], share, strict=True))
                for k in range(len(langs)):
                    got[k] += n * p[b][k] * share[k] / whole
            share = [g / sum(own.values()) for g in got]
        return share, sum(n * math.log(sum(x * y for x, y in zip(p[b], share, strict=True))) for b, n in own.items())

    out = {}
    for i, t, _ in rows:
        own = counts(t or "")
        if not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        share, _ = em(own, [1 / len(langs)] * len(langs), steps)
        ranked = sorted(range(len(langs)), key=lambda k: -share[k])
        found = []
        for s in range(1, len(langs) + 1):
            start = [max(share[k], 1e-3) if k in ranked[:s] else 0.0 for k in range(len(langs))]
            fitted, like = em(own, [x / sum(start) for x in start], 0 if s == 1 else steps // 2)
            found.append((like - (s - 1) * penalty * math.log(max(2.0, sum(own.values()))), -s, fitted))
        best = max(found)[2]
        k = max(range(len(langs)), key=lambda k: best[k])
        out[i] = (langs[k], best[k])
    return out


def substrings(docs, size=50):
    """Removed words by comparing word lists of all documents."""
    cut = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in cut:
        for s in range(len(w) - size + 1) if i is not None else ():
            k = tuple(w[s : s + size])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1) if i is not None else ():
            if least[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append({"doc_id": i, "n_words": len(w), "n_removed": sum(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def _leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def _tree(hashes):
    """Levels of a tree from the leaves up."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def merkle(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {x: _tree([_leaf(r) for r in groups[x]]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            now, proof = r[4], ""
            if r[0] is not None and crc(r[0]) % 3 == 0 and now is not None:
                now = ascii_lower(now)
            folded = _leaf((*r[:4], now))
            for levels, at in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    a = at // 8 * 8
                    run = level[a : a + 8]
                    proof += "".join(run[: at - a] + run[at - a + 1 :])
                    folded = sha("".join([*run[: at - a], folded, *run[at - a + 1 :]]))
                    at //= 8
            out.append({"doc_id": r[0], "leaf": trees[x][0][i], "subroot": trees[x][-1][0], "root": top[-1][0], "proof_sha256": sha(proof), "folded_root": folded, "verified": folded == top[-1][0]})
    return out


def alignment(docs):
    """Groups from the offsets where both tokenizers' tokens end, links by comparing all intervals of a text."""
    import json

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    with open(path) as f:
        names = {i: x for x, i in json.load(f)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    each = []
    for i, text in docs:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        data = [[bytes(letters[c] for c in names[x]) for x in a], [piece(x) for x in b]]
        if not text or not b"".join(data[0]) == b"".join(data[1]) == (" " + text).encode():
            each.append((i, [], [], "", 0, []))
            continue
        spans = []
        for ids, parts in zip((a, b), data, strict=True):
            at, out = 0, []
            for x, p in zip(ids, parts, strict=True):
                out.append((x, at, at + len(p)))
                at += len(p)
            spans.append(out)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[], []]
        for side in (0, 1):
            groups[side] = [[] for _ in both]
            for x, s, _ in spans[side]:
                groups[side][sum(c <= s for c in both)].append(str(x))
        links = [(x, y) for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
        each.append((i, a, b, ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(*groups, strict=True)), len(both), links))
    count, top = {}, {}
    for *_, links in each:
        for p in set(links):
            count[p] = count.get(p, 0) + 1
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return [{"doc_id": i, "n_a": len(a), "n_b": len(b), "n_groups": n, "n_links": len(links), "n_best": sum(count[p] == top[p[0]] for p in links), "count_sum": sum(count[p] for p in links), "groups_sha256": sha(g) if a else ""} for i, a, b, g, n, links in each]


def notices(text, table):
    """(start, label, errors) of the best matches that don't overlap, from the edit distance of every substring."""
    out = []
    for notice in table:
        pattern, e = notice.text, notice.errors
        found = {}
        for a in range(len(text)):
            row = list(range(len(pattern) + 1))
            for b in range(a, min(len(text), a + len(pattern) + e)):
                new = [row[0] + 1]
                for k, c in enumerate(pattern):
                    new.append(min(row[k] + (c != text[b]), row[k + 1] + 1, new[k] + 1))
                row = new
                if row[-1] <= e:
                    found[a, b + 1] = row[-1]
        left = [(0, len(text))]
        while left:
            a, b = left.pop()
            inside = [(n, x, y) for (x, y), n in found.items() if a <= x and y <= b]
            if inside:
                n, x, _ = min(inside)
                y = max(y for m, z, y in inside if (m, z) == (n, x))
                out.append((x, notice.label, n))
                left += [(a, x), (y, b)]
    return sorted(out)

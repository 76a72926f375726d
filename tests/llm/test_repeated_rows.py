"""Rows that repeat a doc_id, with other texts and with the same: every operator against a brute-force version that goes by rows."""

import collections
import hashlib
import math
import zlib

import pytest

from faultline.llm import exact_dedup, langid, lm_scoring, minhash_dedup, mixing, packing, quality_rules, substring_dedup, suffix_dedup, token_counts
from tests.llm.conftest import prose
from tests.llm.test_operators import targets_by_force

A, B, C = prose(1, 120), prose(2, 130), prose(3, 90)
SHARED = "Common line of the host goes here again"


@pytest.fixture(scope="module")
def rows():
    out = [(1, A, "en", "s1"), (1, B, "en", "s1"), (2, A + " tail", "en", "s2"), (3, B + " tail", "de", "s2"), (4, C, None, "s1"), (4, C, "en", "s1"), (4, None, "en", "s1"), (5, "", "en", None),
           (5, "12345", "en", None), (5, "hello there", "en", None), (None, A, "en", "s1"), (None, C + " x", "de", "s1"), (6, "a<|endoftext|>b", "en", "s2"), (7, B, "en", "s2"), (7, B, "en", "s1")]
    out += [(100 + i, SHARED + "\n" + prose(50 + i, 60), "en", "h") for i in range(22)] + [(100, SHARED + "\n" + prose(90, 70), "en", "h")] * 2
    out += [(200 + i, prose(200 + i, 60), "en", "h") for i in range(360)] + [(900, None, "en", "h"), (901, "", "en", "h")]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


LOW = -1 << 63


def own(d):
    return LOW if d is None else d


def test_near_groups(table, rows):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((own(d), {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            both = len(x & y)
            if both and 100 * both >= 85 * (len(x) + len(y) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    name = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        name[root(i)].append(d)
    want = collections.Counter((d, len(x), min(name[root(i)]), d == min(name[root(i)])) for i, (d, x) in enumerate(sets))
    got = collections.Counter((own(r.doc_id), r.n_shingles, own(r.component_id), r.kept) for r in minhash_dedup.near_groups(table, width=3, percent=85).collect())
    # A kept of a null doc_id is null; it counts as kept.
    assert {k[:3]: n for k, n in got.items()} == {k[:3]: n for k, n in want.items()}
    left = minhash_dedup.deduplicate(table, width=3, percent=85).collect()
    groups = {root(i) for i, (_, x) in enumerate(sets) if x}
    assert len(left) == len(groups) + sum(not x for _, x in sets)


def test_packing(table, rows):
    from tokenizers import Tokenizer
    from public_tokenizers import path

    t = Tokenizer.from_file(path(packing.VOCABULARY))
    want = collections.Counter()
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    out = packing.pack(table).collect()
    assert collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048


def lines_by_force(rows):
    import re

    norm = lambda x: re.sub(r"[\x20\t-\r]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    held, texts = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, s in rows:
        texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if x.split():
                held[s, norm(x)].add(t)
    hot = {k for k, v in held.items() if len(v) > 20 and len(v) > 0.05 * len(texts[k[0]])}
    return collections.Counter((d, len((t or "").split()), sum(len(x.split()) for x in (t or "").split("\n") if x.split() and (s, norm(x)) in hot)) for d, t, _, s in rows)


def test_quality(table, rows):
    out = quality_rules.quality(table).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.removed_words) for r in out) == lines_by_force(rows)
    assert quality_rules.strip_lines(table).filter("doc_id = 100").filter(f"text like '%{SHARED}%'").count() == 0


def test_suffix(table, rows):
    """Documents are (doc_id, text), in this order; rows that are alike are one document."""
    hashes = {(r.doc_id, r.text): r.h for r in table.select("doc_id", "text", suffix_dedup.text_hash().alias("h")).collect()}
    docs = sorted({(own(d), hashes[d, t], (t or "").encode()) for d, t, *_ in rows})
    first = {}
    for k, (_, _, t) in enumerate(docs):
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (k, i))
    want = {}
    for k, (d, h, t) in enumerate(docs):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] != (k, i):
                gone[i : i + 100] = b"\1" * 100
        want[d, len(t), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()] = sum(gone)
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(table, bits=20)).collect()
    assert len(out) == len(rows)
    assert {(own(r.doc_id), r.n_bytes, r.kept_sha256): r.n_removed for r in out} == want


def test_substring(table, rows):
    first = {}
    for d, t, *_ in rows:
        w = (t or "").split()
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(own(d), first.get(tuple(w[i : i + 50]), own(d)))
    want = collections.Counter()
    for d, t, *_ in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < own(d):
                gone[i : i + 50] = [True] * 50
        want[own(d), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    assert collections.Counter((own(r.doc_id), *tuple(r)[1:]) for r in substring_dedup.digest(substring_dedup.remove_repeats(table, bits=20)).collect()) == want


def test_mixing(table, rows):
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = targets_by_force(sizes)
    out = mixing.mix(table).collect()
    assert collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out) == collections.Counter((d, size(t), sizes[s], round(want[s], 6)) for d, t, _, s in rows)
    taken = collections.Counter()
    mixed = mixing.mixed_rows(table).collect()
    for r in mixed:
        taken[r.source] += size(r.text)
    total = collections.Counter()
    for r in out:
        total[r.source_size] += r.taken
    assert sum(taken.values()) == sum(total.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(size(t) for _, t, _, x in rows if x == s) / 2 + 1
    each = collections.Counter((r.doc_id, r.text, r.source) for r in mixed)
    there = collections.Counter((d, t, s) for d, t, _, s in rows)
    assert all(n <= 2 * there[k] for k, n in each.items())


def test_exact(table, rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(own(d))
    got = collections.Counter((own(r.doc_id), own(r.keep_id), r.group_size) for r in exact_dedup.exact_groups(table).collect())
    assert got == collections.Counter((own(d), max(groups[t or ""]), len(groups[t or ""])) for d, t, *_ in rows)
    assert len(exact_dedup.deduplicate(table).collect()) == len(groups)


def test_lm(table, rows):
    out = lm_scoring.score_documents(table).collect()
    held = lambda d: zlib.crc32(str(own(d)).encode()) % 7 == 2
    c = collections.Counter(w for d, t, *_ in rows if not held(d) for w in [*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    base = lambda t: round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*(t or "").lower().split(), None]), 6)
    assert collections.Counter((r.doc_id, round(r.base_score, 6)) for r in out) == collections.Counter((d, base(t)) for d, t, *_ in rows)


def test_tokens(table, rows):
    from tokenizers import Tokenizer
    from public_tokenizers import path

    t = Tokenizer.from_file(path(token_counts.VOCABULARY))
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)

    def edited(text):
        for place, deleted, inserted in token_counts.standing_edits(text):
            place = min(place, len(text))
            text = text[:place] + inserted + text[place + deleted :]
        return n(text)

    got = collections.Counter((r.doc_id, r.n_tokens, r.edited_tokens) for r in token_counts.count_tokens(table).collect())
    assert got == collections.Counter((d, n(x or ""), edited(x or "")) for d, x, *_ in rows)


def test_language(table, rows):
    every = langid.identify(table).collect()
    assert len(every) == len(rows)
    und = collections.Counter(r.doc_id for r in every if r.lang_pred == "und")
    assert und == collections.Counter(d for d, t, *_ in rows if not any(ch.isalpha() for ch in t or ""))
    assert collections.Counter((r.doc_id, r.text) for r in langid.keep_known(table).collect()) == collections.Counter((d, t) for d, t, *_ in rows if any(ch.isalpha() for ch in t or ""))

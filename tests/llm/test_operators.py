"""The ten operators against brute force, exact round trips and held-out accuracy, on small
tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import bpe, decontaminate, exact_dedup, language, line_templates, lm_score, ngram_join, pii, toxicity, url_filter

EXTRA = "doc_id bigint, text string, score string, kept string, label string, digest string, host string"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The frame with further columns whose names operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("score", "kept", "label", "digest", "host", "spans", "ids", "lang_pred", "segment", "keep_id")})


EDGES = [(1, None), (2, ""), (3, "   \n\t"), (4, "a"), (4, "a"), (None, "b c"), (7, "wort " * 30_000), (8, "漢字 😀 é")]

# ---- 5 -----------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    rows = [*EDGES, (9, "x  y"), (10, "x\ty"), (11, "X y"), *[(100 + i, "same") for i in range(200)]]
    got = exact_dedup.duplicate_groups(clashing(frame(spark, rows))).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(clashing(frame(spark, rows)))
    assert kept.count() == len(groups) and "keep_id" in kept.columns
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0


# ---- 2 -----------------------------------------------------------------------------------------


def brute_hits(docs, items):
    out = []
    for text in docs:
        words, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
        for item, t in items:
            for w in decontaminate.windows_of(decontaminate.words_of((t or "").encode())):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        found.add(item)
        out.append((len(words), len(hit), found))
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    items = [(1, " ".join(word() for _ in range(14))), (2, "Ab, CD"), (3, None), (4, ""), (5, "zz " * 10)]
    docs = [*[t for _, t in EDGES], *[" ".join(word() for _ in range(60)) for _ in range(30)], f"x {items[0][1]} y {items[0][1]}", "zz " * 25]
    df = clashing(frame(spark, [(i // 2, t) for i, t in enumerate(docs)]))
    for block in (400_000, 5):
        got = decontaminate.contamination(df, frame(spark, items, "item_id bigint, text string"), block_words=block).collect()
        seen = sorted((r.n_words, len({p for m in r.matches for p in range(m.start, m.end)}), tuple(sorted({m.item_id for m in r.matches}))) for r in got)
        assert seen == sorted((n, h, tuple(sorted(f))) for n, h, f in brute_hits(docs, items))
    left = decontaminate.drop_contaminated(df, frame(spark, items, "item_id bigint, text string"))
    assert left.columns == df.columns and left.count() == sum(not f for _, _, f in brute_hits(docs, items))
    assert decontaminate.contamination(frame(spark, []), frame(spark, items, "item_id bigint, text string")).count() == 0
    assert decontaminate.contamination(frame(spark, [(1, "a b")]), frame(spark, [], "item_id bigint, text string")).first().matches == []


def test_proximity(spark):
    docs = frame(spark, [(1, "p q r s t"), (2, "p x q r s t"), (3, "p x x x x x q r s t")])
    items = frame(spark, [(1, "p q r s t")], "item_id bigint, text string")
    got = {r.doc_id: bool(r.matches) for r in decontaminate.contamination(docs, items, slop=1).collect()}
    assert got == {1: True, 2: True, 3: False}


# ---- 3 -----------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7?q=1", "https://x.example.com/en/9#a", "ftp://example.net/de/8", "http://net/de/", "http://notnet/de/", "no url", None, "", "http://", "http://org/es/x/y", "http://a.org?/es/", "http://q.com/en"]
    pages = frame(spark, list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.Model()).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("x.example.com", "/en/9", "com/en/", "block"),
        ("example.net", "/de/8", "example.net/de/8", "block"),
        ("net", "/de/", "net/de/", "allow"),
        ("notnet", "/de/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("org", "/es/x/y", "org/es/", "block"),
        ("a.org", "", None, "allow"),
        ("q.com", "/en", None, "allow"),
    ]


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 7}.{'bad' if i % 2 else 'good'}/{'1' * (i % 5)}/p?{'a=1&' * (i % 3)}", i % 2) for i in range(400)]
    labelled = frame(spark, rows, "page_id bigint, url string, label int")
    model = url_filter.train(labelled)
    assert model.trees
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(clashing(labelled.select("page_id", "url")), model, rules=[]).collect()}
    assert sum((verdicts[i] == "block") == (i % 2 == 1) for i in range(400)) > 390
    assert url_filter.train(labelled.limit(0)).trees == [] and url_filter.train(labelled.filter("label = 1")).start > 0


def test_url_trees_learn_beside_a_hot_url(spark):
    # The hot url's hash is below its class's limit, so its copies come first and in full.
    at = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / (1 << 30)
    tried = frame(spark, [(f"http://hot{i}.bad/1/p",) for i in range(2_000)], "url string")
    hot = tried.orderBy(at).first().url
    rows = [(hot, 1)] * 2_000 + [(f"http://h{i}.{'bad' if i % 2 else 'good'}/{'1' * (i % 5)}/p", i % 2) for i in range(400)]
    model = url_filter.train(frame(spark, rows, "url string, label int").coalesce(1), most=100)
    assert model.trees
    pages = frame(spark, [(i, f"http://new{i}.{'bad' if i % 2 else 'good'}/1/p") for i in range(40)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, model, rules=[]).collect()}
    assert all((got[i] == "block") == (i % 2 == 1) for i in range(40))


# ---- 6 -----------------------------------------------------------------------------------------


def test_line_templates(spark):
    rows = [(i, f"Request {i} from 10.0.0.{i} took {i} ms\nown line number of {'abc'[i % 3]} {chr(97 + i)}{chr(98 + i)}\n\nCookie notice here now") for i in range(12)]
    rows += [(100, None), (101, ""), (102, "Cookie notice here now"), (102, "Cookie notice here now"), (103, "long " * 20_000)]
    got = line_templates.drop_recurring_lines(clashing(frame(spark, rows)), min_docs=10, similarity=0.9).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].clean_text == "own line number of a ab\n" and (by[0].n_lines, by[0].n_dropped) == (4, 2)
    assert by[100].clean_text is None and by[100].n_lines == 0 and by[101].clean_text == "" and by[103].n_dropped == 0
    assert [r.clean_text for r in got if r.doc_id == 102] == ["", ""] and len(got) == len(rows)
    assert line_templates.drop_recurring_lines(frame(spark, [])).count() == 0


def test_line_templates_generalise_words(spark):
    rows = [(i, f"please share this page with {w} today or later") for i, w in enumerate("ann bob cid dan eva fay gus hal ida jon".split())] + [(99, "please share this box of nothing at all else")]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(frame(spark, rows), min_docs=10).collect()}
    assert all(got[i] == 1 for i in range(10)) and got[99] == 0


def test_line_templates_several_in_a_leaf(spark):
    rows = [(i, f"please share this page with {chr(97 + i)}x today or later") for i in range(20)]
    rows += [(100 + i, f"please share this offer from {chr(97 + i)}y before next sunday") for i in range(18)]
    rows += [(200, "please share this box of nothing at all else")]
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(frame(spark, rows), min_docs=10).collect()}
    assert all(n == int(i != 200) for i, n in got.items())


def test_line_templates_equally_common_in_a_leaf(spark):
    kinds = ["we are not {} by any of these means", "we are not over {} in a quiet manner", "we are not what {} hoped from her sister", "we are not to follow {} without good cause"]
    rows = [(100 * k + i, kind.format(chr(97 + i) + "z")) for k, kind in enumerate(kinds) for i in range(12)]
    got = line_templates.drop_recurring_lines(frame(spark, rows), min_docs=10).collect()
    assert [r.n_dropped for r in got] == [1] * len(rows)


# ---- 1 -----------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(2)
    texts = ["a@b.c", "é😀 a.b+c@x-y.co.uk, q@w", "1.2.3.4 256.1.1.1 01.002.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (656) 555-6510 +12", "a@b.c_x@y.z", None, "", "1" * 5000, "a@b." * 3000 + "c", "word" * 20_000, "1.1.1.1 " * 2000]
    texts += ["".join(rng.choice("ab@.1234567890 -+()%😀\n") for _ in range(80)) for _ in range(400)]
    got = pii.extract(clashing(frame(spark, list(enumerate(texts))))).select("doc_id", *pii.KINDS, "base").collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.start, s["rank"], s.end) for s in r.base] == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"text {'xyz'[i % 3]} contact: user{i}@mail.example.com please") for i in range(12)]
    rows += [(50, "text contact: hidden7@intranet please"), (51, "the room 7@x again"), (52, None), (53, "")]
    got = {r.doc_id: r for r in pii.extract(frame(spark, rows)).collect()}
    added = {i: [(s.start, s.end) for s in r.spans if s not in r.base] for i, r in got.items()}
    assert added.pop(50) == [(14, 30)] and not any(added.values())
    assert pii.extract(frame(spark, [])).count() == 0


@pytest.mark.parametrize("unseen", [1, 4, 11])
def test_unseen_identifiers_do_not_count_against_their_pattern(spark, unseen):
    rows = [(i, f"text contact: user{i}@mail.example.com please") for i in range(12)] + [(100 + i, f"text contact: hidden{i}@intranet please") for i in range(unseen)]
    rows += [(200 + i, f"the room {i} again") for i in range(30)] + [(300, "the room a@b again")]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s not in r.base] for r in pii.extract(frame(spark, rows)).collect()}
    assert all(got[100 + i] == [f"hidden{i}@intranet"] for i in range(unseen))
    assert not any(found for i, found in got.items() if not 100 <= i < 200)


def test_personal_data_keeps_columns_and_repeated_rows(spark):
    rows = [(1, "a@b.co and 1.2.3.4"), (1, "a@b.co and 1.2.3.4"), (1, None), (None, "+1 (656) 555-6510"), (None, None)]
    df = frame(spark, rows).withColumns({"email": F.lit("mine"), "base": F.lit("x"), "__x": F.lit(3), "left": F.lit("l")})
    got = pii.extract(df)
    assert got.columns == ["doc_id", "text", "__x", "left", *pii.KINDS, "base", "spans"]
    assert sorted((str(r.doc_id), str(r.text), r.left, len(r.spans)) for r in got.collect()) == sorted((str(i), str(t), "l", len(brute_spans(t))) for i, t in rows)


def test_bootstrap_needs_words_on_one_side_only(spark):
    wide = " " * 60
    rows = [(i, f"text {'xyz'[i % 3]} contact: user{i}@mail.example.com please") for i in range(40)]
    rows += [(100, "text contact: hidden7@intranet"), (101, "hidden8@intranet please"), (102, f"text contact:{wide}hidden9@intranet")]
    got = {r.doc_id: r for r in pii.extract(frame(spark, rows)).collect()}
    added = {i: [r.text[s.start : s.end] for s in r.spans if s not in r.base] for i, r in got.items()}
    assert [added.pop(i) for i in (100, 101, 102)] == [["hidden7@intranet"], ["hidden8@intranet"], ["hidden9@intranet"]] and not any(added.values())
    ends = [(i, f"reach us under user{i}@mail.example.com") for i in range(40)] + [(100, "reach us under hidden7@intranet")]
    got = {r.doc_id: [s for s in r.spans if s not in r.base] for r in pii.extract(frame(spark, ends)).collect()}
    assert [(s.start, s.end) for s in got[100]] == [(15, 31)]


def test_bootstrap_strips_punctuation_and_parts_lists(spark):
    rows = [(i, f"text {'xyz'[i % 3]} contact: user{i}@mail.example.com please") for i in range(40)]
    rows += [(100 + i, f"text {'xyz'[i % 3]} dial +1 656 555 {6510 + i} today") for i in range(40)]
    odd = {
        200: ("contact: hidden7@intranet.", ["hidden7@intranet"]),
        201: ("contact: <hidden7@intranet>, please", ["hidden7@intranet"]),
        202: ("contact: someone@mail.example.com, hidden8@intranet, hidden9@intranet please", ["hidden8@intranet", "hidden9@intranet"]),
        203: ("contact: hidden8@intranet hidden9@intranet please", ["hidden8@intranet", "hidden9@intranet"]),
        204: ("dial (555) 123-4567. today", ["(555) 123-4567"]),
        205: ("dial (555-123-4567), (555) 123-4568; 555 123 4569! today", ["555-123-4567", "(555) 123-4568", "555 123 4569"]),
        206: ("dial 7 today", []),
    }
    got = {r.doc_id: r for r in pii.extract(frame(spark, rows + [(i, t) for i, (t, _) in odd.items()])).collect()}
    added = {i: [r.text[s.start : s.end] for s in r.spans if s not in r.base] for i, r in got.items()}
    assert {i: added.pop(i) for i in odd} == {i: found for i, (_, found) in odd.items()} and not any(added.values())


# ---- 4 -----------------------------------------------------------------------------------------


def test_lm_scores(spark):
    rng = random.Random(3)
    circle = "the cat sat on a mat near Zebra".split()
    walk = lambda at, n: " ".join(circle[(at + k + (rng.random() < 0.1)) % 8] for k in range(n))
    rows = [(i, walk(rng.randrange(8), rng.randint(0, 12))) for i in range(200)] + [(500, None), (501, ""), (501, ""), (None, "the cat")]
    df = clashing(frame(spark, rows)).withColumn("__fold", F.coalesce(F.col("doc_id") % 10, F.lit(0)))
    got = lm_score.score(df).collect()
    assert len(got) == len(rows)
    training = [lm_score.tokens_of((t or "").encode()) for i, t in rows if i is not None and i % 10]
    counts = collections.Counter(w for ws in training for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = collections.Counter(round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lm_score.tokens_of((t or "").encode())), 6) for _, t in rows)
    assert collections.Counter(round(r.base_score, 6) for r in got) == base
    assert {r.train_tokens for r in got} == {n} and sum(r.held_out for r in got) == sum(i is None or i % 10 == 0 for i, _ in rows)
    held = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score(df.limit(0)).count() == 0


# ---- 7 -----------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return [(i, len(sets[k]), min(ids[find(k)])) for k, (i, _) in enumerate(rows)]


def test_near_duplicates(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 3000)]
    for family in range(12):
        text = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy)))
    got = ngram_join.near_duplicates(clashing(frame(spark, rows))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    left = ngram_join.drop_near_duplicates(frame(spark, rows))
    assert left.count() == len({c for _, _, c in brute_components(rows)})
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("cell", [7, 1024])
def test_cells_agree_with_sets(monkeypatch, spark, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    rng = random.Random(5)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(text)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(60)] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows)


def brute_links(rows):
    """How many other texts a text links to."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = (tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    links = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    return {i: len({v for v, s in sets.values() if v != w and links(own, s)}) for i, (w, own) in sets.items()}


def test_prefixes_that_connect_without_links(spark):
    """A chain of texts, each sharing a part with the next, and a hub part in many: no link."""
    part = lambda k: " ".join(f"p{k}w{i}" for i in range(20))
    rows = [(k, f"{part(k)} {part(k + 1)} {part(k + 2)}") for k in range(0, 300, 2)] + [(1000 + k, f"{part('hub')} {part(1000 + k)}") for k in range(150)]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got) and len(got) == len(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(4_000):
        copy = list(base)
        copy[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == len(rows)
    # Two texts link unless their changes lie so far apart that ten shingles are lost on either side.
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in rows]
    for i in (0, 1, 1999, 3999):
        assert next(r.n_links for r in got if r.doc_id == i) == sum(j != i and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in enumerate(sets))


def test_near_duplicates_without_ids_or_with_one(spark):
    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(None, text + " a"), (None, text + " b"), (None, other + " a"), (None, other + " b"), (None, "")]
    rows += [(7, text.upper().replace("W", "x") + c) for c in (" a", " b", " c")]
    left = sorted(str(r.text)[:2] for r in ngram_join.drop_near_duplicates(frame(spark, rows)).collect())
    assert left == ["", "v0", "w0", "x0"]
    assert ngram_join.near_duplicates(frame(spark, [(1, "a b")]).coalesce(1)).first().n_shingles == 1


def test_unknown_languages_keep_texts_with_letters(spark):
    rows = [(1, "some text", None), (2, "12 !?", None), (3, None, None), (4, "漢字", None)]
    kept = language.keep_known_languages(frame(spark, rows, "doc_id bigint, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


# ---- 8 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.load_ranks(f.read())
    return path, public_tokenizers.PATTERN, bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, vocabulary):
    path, pattern, _, reference = vocabulary
    rng = random.Random(6)
    texts = [t for _, t in EDGES] + ["<|endoftext|> I'll we've", "a" * 3000] + ["".join(rng.choice("abeht rsno' \n\t0123éß漢😀.,!") for _ in range(60)) for _ in range(200)]
    encoded = bpe.encode(clashing(frame(spark, list(enumerate(texts)))), path, pattern)
    for r in bpe.decode(encoded, path).collect():
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text) and bytes(r.decoded).decode() == text
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def test_bpe_appends_and_edits(vocabulary):
    _, pattern, own, reference = vocabulary
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice("abc 's\n re'é1") for _ in range(n))
    for _ in range(60):
        e = bpe.Encoded(own, pattern, draw(30))
        for _ in range(4):
            a = rng.randint(0, len(e.text))
            e.edit(a, min(len(e.text), a + rng.randint(0, 4)), draw(rng.randint(0, 5)))
            assert e.ids == reference.encode_ordinary(e.text)
        e.append("'re x")
        assert e.ids == reference.encode_ordinary(e.text)
    last, start = [], []
    own.extend(b"tokens", last, start)
    own.extend(b"tokens again", last, start)
    assert list(bpe.read_back(last, start)) == list(own.encode_piece(b"tokens again"))


# ---- 9 -----------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(8)
    parts = {"xx": "ka lo mi", "yy": "sch ung ver", "zz": "oux eau tre"}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k].split(), k=2)) for _ in range(n))
    rows = [(i, text(k, rng.randint(8, 60)), k) for i, k in enumerate(list(parts) * 60)]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    net = language.train(language.sample(docs, per_lang=50))
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "12 34 !?", "xx"), (1003, text("yy", 20_000), None)]
    got = {r.doc_id: r for r in language.predict(clashing(frame(spark, rows + odd, docs.schema)), net).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 0.97 * len(rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "yy"] and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.train(language.sample(docs.limit(0)))
    assert language.predict(docs.limit(3), nothing).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = language.keep_known_languages(clashing(frame(spark, rows + odd, docs.schema)))
    assert kept.count() == len(rows) + 1 and {r.score for r in kept.select("score").distinct().collect()} == {"x"}


def test_folded_network_gives_the_same_sums():
    net = language.train([("a", "abc" * 40), ("b", "xyz" * 40)] * 40, epochs=1)
    windows = np.random.default_rng(1).integers(0, 256, (9, language.WINDOW), dtype=np.uint8)
    top, _ = net.pooled(windows)
    assert np.allclose(language._softmax(top @ net.out + net.out_bias), net.folded().probabilities(windows), atol=1e-4)


# ---- 10 ----------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice("bright small green house river stone walks sings every morning".split()) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["Moron", "idiot", "scumbag"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 5 == 0)))
    docs = clashing(frame(spark, [*rows, (1000, None), (1001, ""), (1002, "river " * 30_000 + "idiot")]))
    labels = frame(spark, [*marks, (1, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predict(docs, toxicity.train(toxicity.sample(docs.filter("doc_id < 300"), labels))).collect()}
    held = range(300, 400)
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1002].score > 0.5 > got[1001].score == got[1000].score
    assert toxicity.predict(docs, toxicity.train([])).filter("score = 0.5").count() == 403


def test_toxicity_trains_on_whole_texts(spark):
    calm = "river stone house morning " * 2_500
    rows = [(i, calm + ("scumbag moron" if i % 2 else "willow meadow")) for i in range(40)]
    docs = frame(spark, rows)
    labels = frame(spark, [(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    scorer = toxicity.train(toxicity.sample(docs, labels))
    held = frame(spark, [(100, "a scumbag moron"), (101, "a willow meadow")])
    got = {r.doc_id: r.score for r in toxicity.predict(held, scorer).collect()}
    assert got[100] > 0.7 > 0.3 > got[101]


def test_samples_do_not_depend_on_ids_or_copies(spark):
    """Null ids, one id for all, and rows that repeat by the thousand."""
    words = {"aa": "bona vita sole mare", "bb": "xyl grok trum pfeng"}
    texts = [(k, f"{w} {i} {w[::-1]}") for k, w in words.items() for i in range(300)]
    schema = "doc_id bigint, text string, lang string"
    for ids in (lambda i: None, lambda i: 5, lambda i: i):
        docs = frame(spark, [(ids(i), t, k) for i, (k, t) in enumerate(texts)] + [(9, "the same again and again", "aa")] * 2000, schema)
        got = language.sample(docs.repartition(3), per_lang=50)
        assert collections.Counter(k for k, _ in got) == {"aa": 100, "bb": 100}
        assert got == language.sample(docs.repartition(7), per_lang=50)
    assert len(language.sample(frame(spark, [(1, "one text", "aa")] * 3000, schema), per_lang=50)) == 2

    docs = frame(spark, [(1, "you utter fool")] * 10_000 + [(2, f"a fine day {i}") for i in range(3000)] + [(3, None), (None, "unlabelled")])
    labels = frame(spark, [(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (4, 7)], "doc_id bigint, toxic int")
    got = toxicity.sample(docs.repartition(3), labels, per_class=40)
    assert collections.Counter(t for t, _ in got) == {0: 40, 1: 2}
    again = toxicity.sample(docs.repartition(8), labels, per_class=40)
    assert [(t, p.tolist()) for t, p in got] == [(t, p.tolist()) for t, p in again]
    for few in (labels.limit(0), labels.filter("doc_id = 4")):
        assert toxicity.sample(docs, few) == []
    assert toxicity.sample(docs.limit(0), labels) == []


def test_toxicity_scores_are_calibrated():
    """Held-out scores mean what they say where classes weigh alike, and few n-grams win among noise."""
    draw = random.Random(4)
    noise = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(4000)]
    def text(toxic):  # one insult in nine of ten toxic texts, among words of chance
        words = draw.choices(noise, k=40)
        return " ".join([*words, "scumbagg"] if toxic and draw.random() < 0.9 else words)
    rows = [(int(i % 8 == 0), text(i % 8 == 0)) for i in range(1200)]
    scorer = toxicity.train([(t, toxicity._distinct(x)) for t, x in rows[:800]])
    scores, y = scorer.score([x for _, x in rows[800:]]), np.array([t for t, _ in rows[800:]])
    assert (scores[y == 1] >= 0.7).mean() >= 0.8 and (scores[y == 0] < 0.7).mean() >= 0.98
    x = np.concatenate([np.random.default_rng(1).normal(-3, 2, 20_000), np.random.default_rng(2).normal(3, 2, 20_000)])
    slope, offset, _ = toxicity._calibrated(x, np.arange(40_000) >= 20_000)
    # Two normal distributions of variance 4 and means -3 and 3 have log odds of 1.5 x.
    assert abs(slope - 1.5) < 0.1 and abs(offset) < 0.1


def test_a_word_is_encoded_once_whatever_stands_behind_it():
    import regex

    from terrace.llm import bpe

    asked = []
    find = regex.compile(r" ?\w+| ?[^\s\w]+|\s+").findall
    first = bpe.Memory(find, lambda piece: asked.append(piece) or tuple(piece), "")
    later = bpe.Memory(find, first.encode_piece, " ", first)
    assert [later[c] for c in ("word", "word,", "word.", "word,word")] == [tuple(b) for b in (b" word", b" word,", b" word.", b" word,word")]
    assert sorted(asked) == [b" word", b",", b".", b"word"]

"""Decontamination, line chunks, quality rules, language and their odd inputs."""

import hashlib
import random
import re

import pytest

from lodestone.llm import decontaminate as dc
from lodestone.llm import language as lang
from lodestone.llm import line_dedup as ld
from lodestone.llm import quality as q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [(1, None), (None, ""), (3, "x" * 300_000), (4, "é ß\n\n 你好 #$%"), (4, "é ß\n\n 你好 #$%"), (6, "a " * 50_000)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, who = set(), set()
    for name, item in items:
        w = WORD.findall(lower(item))
        for p in range(max(1, len(w) - window + 1) if w else 0):
            part = w[p : p + window]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    who.add(str(name))
    return len(words), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocab = ["Aa", "bé", "c1", "d", "e-f", "ZZ"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 14, 25])))) for i in range(12)] + [(90, ""), (91, None), (5, "only this")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(120)))) for i in range(40)]
    docs += [(100 + i, "Start " + (t or "") + ". end") for i, (_, t) in enumerate(items)] + ODD
    got = dc.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=repr)
    want = [(i, *(b := brute_contamination(t, items)), b[1] > 0) for i, t in docs]
    assert mine == sorted(want, key=repr)


def test_longest_match_and_places(spark):
    item = " ".join(f"k{i}" for i in range(30))
    text = "one two " + " ".join(item.split()[4:25]) + " three"
    r = dc.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert (r.longest_match, [(s["from"], s["to"]) for s in r.spans], r["items"]) == (21, [(2, 23)], ["8"])


def test_contamination_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "keep")], "doc_id long, text string, N_Hit int, other string")
    none = spark.createDataFrame([], "item_id long, text string")
    out = dc.find_contamination(docs, none).first()
    assert (out.n_hit, out.contaminated, out.other) == (0, False, "keep")
    assert dc.find_contamination(docs.limit(0), none).count() == 0
    assert dc.remove_contaminated(docs, spark.createDataFrame([(None, "A b")], "item_id long, text string")).count() == 0


def brute_lines(rows):
    """Texts after removal, with chunks compared by their bytes over the whole corpus."""
    seen, out = {}, []
    chunks = [(key, n, c[2]) for key in sorted({(i is None, i, t) for i, t in rows if t}, key=repr) for n, c in enumerate(ld.chunks_of(key[2].encode())) if c[1] >= 2 and c[2].strip()]
    order = sorted(chunks, key=lambda x: (x[0][0], x[0][1] or 0, _xx(x[0][2]), x[1]))
    for key, n, body in order:
        seen.setdefault(body, (key, n))
    for i, t in rows:
        parts = [c[2] for n, c in enumerate(ld.chunks_of(t.encode())) if not (c[1] >= 2 and c[2].strip() and seen[c[2]] != ((i is None, i, t), n))] if t else None
        out.append((i, t if parts is None else b"\n".join(parts).decode()))
    return sorted(out, key=repr)


def _xx(text):
    return text


def test_line_chunks_equal_brute_force(spark):
    rng = random.Random(6)
    shared = [[f"shared {k} {i}" for i in range(9)] for k in range(4)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {j}" for j in range(rng.randrange(6))]
        lines += shared[rng.randrange(4)] + [f"tail {i} {j}" for j in range(rng.randrange(4))]
        rows.append((i, "\n".join(lines)))
    rows += [(70, rows[0][1]), (71, None), (72, ""), (73, "\n\n\n\n"), (74, "a\nb\r\n" * 5), (None, rows[1][1]), (80, "z" * 200_000 + "\n" + "y\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.remove_repeated_chunks(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_lines(rows)
    assert sum(r.n_removed_lines for r in got) > 200
    assert {r.doc_id: r.n_removed_lines for r in got}[0] == 0


def test_line_chunks_by_join_and_clashes(spark, monkeypatch):
    rows = [(i, f"a{i}\n" + "\n".join(f"s{j}" for j in range(12)), i, 1) for i in range(6)] + [(0, "a0\n" + "\n".join(f"s{j}" for j in range(12)), 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, h int")
    by_set = sorted(map(tuple, ld.remove_repeated_chunks(df).collect()))
    monkeypatch.setattr(ld, "HELD_HASHES", 0)
    assert sorted(map(tuple, ld.remove_repeated_chunks(df).collect())) == by_set
    assert ld.remove_repeated_chunks(df.limit(0)).count() == 0
    assert ld.remove_repeated_chunks(df).columns == ["doc_id", "text", "h", "n_lines", "n_removed_lines"]


def test_boundaries_resist_shifts():
    passage = [f"p{i}" for i in range(40)]
    a = {c[2] for c in ld.chunks_of("\n".join(["x", *passage]).encode())}
    b = {c[2] for c in ld.chunks_of("\n".join(["x", "y", "z", *passage]).encode())}
    assert len(a & b) >= len(a) // 2


def brute_passages(rows):
    """Lines left by (id, text), and lines removed, if all pairs of neighbouring full lines are compared by their bytes."""
    first, spans = {}, []
    for key in sorted({(i is None, i or 0, t) for i, t in rows if t}):
        lines = key[2].split("\n")
        full = [n for n, x in enumerate(lines) if x.strip()]
        for number, (a, b) in enumerate(zip(full, full[1:])):
            f = first.setdefault("\n".join(lines[a : b + 1]), (key, number))
            if f[0] != key or number - f[1] > 1:
                spans.append((key, a, b))
    out = {}
    for i, t in rows:
        gone = {n for key, a, b in spans if key == (i is None, i or 0, t) for n in range(a, b + 1)}
        out[i, t] = (t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone))
    return out


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_whole_passages_go(spark, monkeypatch, held):
    monkeypatch.setattr(ld, "HELD_HASHES", held)
    rng = random.Random(9)
    shared = [[f"shared {k} {i}" for i in range(2 + k)] for k in range(6)]
    rows = [(k, "\n".join(x)) for k, x in enumerate(shared)]
    for i in range(40):
        k = rng.randrange(6)
        rows.append((100 + i, "\n".join([*[f"own {i} {j}" for j in range(rng.randrange(1, 5))], *shared[k], *[f"tail {i} {j}" for j in range(rng.randrange(1, 4))], "common", f"end {i}"])))
    rows += [(70, "y\n" * 5), (71, None), (72, ""), (73, "\n\n"), (74, "a\n\nb\nown"), (75, "q\na\n\nb\n"), (None, rows[1][1]), (100, rows[6][1])]
    got = ld.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_passages(rows)
    assert sorted(((r.doc_id, r.text, r.n_removed_lines) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t in rows), key=repr)
    texts = {r.doc_id: r.text for r in got}
    assert not any("shared" in texts[100 + i] for i in range(40)) and all("common" in texts[100 + i] for i in range(40))
    assert texts[70] == "y\ny\n" and texts[75] == "q\n" and texts[None] == ""


def brute_whole_copies(rows, share):
    """As ``brute_passages``, but documents with this share of their words in passages of earlier ones keep their text."""
    first = {}
    keys = sorted({(i is None, i or 0, t) for i, t in rows if t})
    pairs = {}
    for key in keys:
        lines = key[2].split("\n")
        full = [n for n, x in enumerate(lines) if x.strip()]
        pairs[key] = [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(full, full[1:])]
        for *_, body in pairs[key]:
            first.setdefault(body, key)
    plain, out = brute_passages(rows), {}
    for i, t in rows:
        key = (i is None, i or 0, t)
        copied = {n for a, b, body in pairs.get(key, []) if first[body] != key for n in range(a, b + 1)}
        words = sum(len(t.split("\n")[n].encode().split()) for n in copied)
        out[i, t] = (t, 0) if copied and words >= share * len(t.encode().split()) else plain[i, t]
    return out


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_whole_copies_stay_whole(spark, monkeypatch, held):
    monkeypatch.setattr(ld, "HELD_HASHES", held)
    rng = random.Random(10)
    base = [f"line {i} of the base text" for i in range(10)]
    rows = [(0, "\n".join(base)), (1, "\n".join(base)), (2, "\n".join(base[:7] + ["other end", "here"])), (3, "\n".join(["mine"] * 3 + ["a line of my own, longer than most"] * 4 + base[:2]))]
    rows += [(10 + i, "\n".join(rng.choice([base[k], f"own {i} {k}"]) for k in range(10))) for i in range(30)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, __gone string, __i string")
    got = {r.doc_id: r for r in ld.remove_repeated_passages(df, copied_share=0.5).collect()}
    want = brute_whole_copies(rows, 0.5)
    assert {i: (got[i].text, got[i].n_removed_lines) for i, _ in rows} == {i: want[i, t] for i, t in rows}
    assert got[1].text == rows[1][1] and got[2].text == rows[2][1] and "base" not in got[3].text and (got[1]["__gone"], got[1]["__i"]) == ("x", "y")


def brute_base(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cé", "#$", "d\ne", "\x1cq", " z", "l1\nl1\n"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    for t in [*texts, "", None, "a\n\n a\n", "q " * 100]:
        assert q.base_counts(t.encode() if t is not None else None) == brute_base(t)


def test_base_columns_equal_sql(spark, sf_dir):
    from conftest import held_against_sql

    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    mine, theirs = held_against_sql(spark, sf_dir, lambda s, d: q.measure(s.read.parquet(f"{d}/documents.parquet"), []).select(base), q.oracle_base())
    assert mine == theirs


def brute_quality(rows):
    """(nearest, class distance, word distance, kept) by place in rows of (id, text, lang), in plain Python."""
    import math
    import statistics
    import unicodedata

    def shape(t):
        n = {}
        for ch in t:
            k = unicodedata.category(ch)
            c = "sentence" if ch in q.SENTENCE else "blank" if k[0] == "Z" or ch in "\t\n\x0b\x0c\r" else "small" if k == "Ll" else "capital" if k in ("Lu", "Lt") else k[0] if k[0] in "LMN" else "sign" if k[0] in "SP" else "other"
            n[c] = n.get(c, 0) + 1
        return {c: x / len(t) for c, x in n.items()}

    def words(t):
        return re.findall("[a-z\x80-\U0010ffff]+", re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", t.lower()))

    def distance(p, r):
        total = 0
        for k in set(p) | set(r):
            x, y = p.get(k, 0), r.get(k, 0)
            total += (x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
        return math.sqrt(max(0, total / 2))

    taught = {}
    for _, t, lang in rows:
        if t is not None and lang is not None and len(words(t)) >= 50:
            taught.setdefault(lang, []).append(t)
    references = {}
    for lang, texts in taught.items():
        if len(texts) < 10:
            continue
        c, w = {}, {}
        for t in texts:
            for k, x in shape(t).items():
                c[k] = c.get(k, 0) + x / len(texts)
            ws = words(t)
            for k in ws:
                w[k] = w.get(k, 0) + 1 / len(ws) / len(texts)
        references[lang] = c, {k: x for k, x in w.items() if x >= q.COMMON_SHARE}
    out = []
    for _, t, _ in rows:
        base = brute_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        if base[0] < 50 or not references:
            out.append([base[0], failed, None, None, None])
            continue
        ws, best = words(t), None
        for lang, (c, common) in sorted(references.items()):
            mine = {}
            for k in ws:
                k = k if k in common else None
                mine[k] = mine.get(k, 0) + 1 / len(ws)
            d = distance(mine or {None: 1}, common | {None: 1 - sum(common.values())}), distance(shape(t), c), lang
            best = d if best is None or d < best else best
        out.append([base[0], failed, best[2], best[1], best[0]])
    groups = {}
    for n, failed, lang, c, w in out:
        if not failed and lang:
            groups.setdefault((lang, n.bit_length() - 1), []).append((int(c / q.STEP), int(w / q.STEP)))
    limits = {}
    for (lang, length), steps in groups.items():
        if len(steps) >= 10:
            one = []
            for k, (low, high) in enumerate((q.CLASS_BOUNDS, q.WORD_BOUNDS)):
                m = int(statistics.median(s[k] for s in steps))
                d = max(1, int(statistics.median(abs(s[k] - m) for s in steps)))
                one.append(min(high, max(low, (m + 0.5 + q.SPREADS * d) * q.STEP)))
            limits.setdefault(lang, {})[length] = one
    for o in out:
        n, failed, lang, c, w = o
        good = True
        if lang in limits:
            known = sorted(limits[lang])
            most = limits[lang][max((k for k in known if k <= n.bit_length() - 1), default=known[0])]
            good = c <= most[0] and w <= most[1]
        o.append(not failed and good)
    return [tuple(o[2:]) for o in out]


def test_quality_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9000 + i, t, None) for i, t in enumerate(["\u65e5\u672c\u8a9e " * 60, "\U0001f600 " * 80, "%%% ### " * 40, "e\u0301 \u00df " * 60, None, ""])]
    rows += [(9100 + i, "rare tongue " * 30 + str(i), "rare") for i in range(9)]
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = brute_quality(rows)
    assert sum(not w[3] for w in want) > 10
    for (i, _, _), (lang, c, w, kept) in zip(rows, want):
        r = got[i]
        assert r.nearest == lang and r.kept == kept, (i, r, lang, c, w, kept)
        assert c is None and r.class_distance is None or abs(r.class_distance - c) < 1e-4 and abs(r.word_distance - w) < 1e-4


def test_stray_language_values_teach_nothing(spark):
    prose = "some words of plain prose stand here in a row and then some more of them follow on and on until there are enough of them to be " * 3
    rows = [(i, prose + str(i), f"stray {i}") for i in range(300)] + [(1000 + i, prose + str(i), "en") for i in range(20)]
    assert [r["lang"] for r in q.learn_references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))] == ["en"]


def test_quality_clashes_and_nulls(spark):
    df = spark.createDataFrame([(None, None, None, "a", "b", "c", 1)], "doc_id long, text string, lang string, __lang string, __text string, nearest string, base_failed int")
    r = q.quality_rules(df).first()
    assert (r["__lang"], r["__text"], r.nearest, r.base_failed, r.kept, r.n_words) == ("a", "b", None, True, False, 0)


def test_quality_verdicts(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)) + "."
    clean = [(i, prose(120), "en") for i in range(60)]
    junk = [(100, " ".join(w + "%%%" for w in prose(120).split()), "en"), (101, prose(120).upper().replace(" ", "!! "), None), (102, "same again here " * 60, "en"), (103, "short text", "en")]
    odd = [(200 + k, t, "en") for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(clean + junk + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in clean)
    assert not any(got[i] for i, _, _ in junk + odd)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert q.quality_rules(empty).count() == 0
    no_lang = spark.createDataFrame([(1, prose(80), None, 1)], "doc_id long, text string, lang string, kept int")
    assert q.quality_rules(no_lang).first().kept is True


def test_language_learns_and_predicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got = lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.93 * len(got) and len(got) > 30
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_in_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    one = sorted(map(tuple, lang.identify(docs).collect()))
    monkeypatch.setattr(lang, "BLOCK_LANGUAGES", 1)
    many = sorted(map(tuple, lang.identify(docs).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in many] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(one, many))
    assert len({r[2] for r in one}) > 2


def test_stray_languages_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(lang, "LEARNED", 10)
    docs = spark.createDataFrame([(i, "plain words of text", "en" if i < 50 else f"stray{i}") for i in range(80)], "doc_id long, text string, lang string")
    assert [sorted(b) for b in lang.learn_prototypes(docs)] == [["en"]]


def test_a_language_of_one_document_in_many_is_learned(spark):
    docs = spark.range(100_000).selectExpr("id AS doc_id", "if(id = 6, 'zyx wvu', 'plain words') AS text", "if(id = 6, 'rare', 'en') AS lang")
    assert docs.filter(~lang.held_out(docs.doc_id)).count() > 65536
    got = lang.identify(docs).filter("doc_id < 10").collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(i, "rare" if i == 6 else "en") for i in range(10)}


@pytest.mark.parametrize("held", [2048, 1, 2])
def test_many_languages_equal_one_comparison(spark, monkeypatch, held):
    """A learned language named und, equal prototypes, and cosines below 0 are judged alike in any blocks."""
    import numpy as np

    monkeypatch.setattr(lang, "BLOCK_LANGUAGES", held)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(30)) + "x", f"l{i % 37:02}") for i in range(80)]
    rows += [(90, "words here", "und"), (91, "words here", "zz"), (92, "words here words here", "zzz")]
    rows += [(200 + i, "".join(rng.choice("стуф") for _ in range(3)), None) for i in range(20)] + [(300, "words here", None), (301, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {r.doc_id for r in docs.filter(~lang.held_out(docs.doc_id)).collect()}
    space, sums = lang.Space(), {}
    for i, t, name in rows:
        if i in taught and name and t:
            sums[name] = sums.get(name, 0) + space.bundle(space.trigrams(t))
    assert len(sums) > 30
    for r in lang.identify(docs).collect():
        t = next(t for i, t, _ in rows if i == r.doc_id)
        if t is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = space.bundle(space.trigrams(t), damped=True)
        cos = {k: round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 10) for k, p in sums.items()}
        assert r.lang_pred == max(sorted(cos), key=cos.get) and abs(r.score - max(0, max(cos.values()))) < 1e-9


def test_prototypes_equal_brute_force(spark):
    """Bundles and cosines against the definition, trigram by trigram."""
    import numpy as np

    texts = [("aa", "Ab ab, c1 ba"), ("aa", "abc"), ("bb", "xyz zyx"), (None, "abc"), ("bb", None)]
    df = spark.createDataFrame([(i, t, lg) for i, (lg, t) in enumerate(texts)], "doc_id long, text string, lang string")
    letters = lang.Space(lang.DIMENSIONS)

    def bundle(t, root=False):
        t = " " + " ".join(re.findall("[a-z]+", t.lower())) + " "
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        total = np.zeros(lang.DIMENSIONS)
        for g in set(grams):
            v = np.roll(letters.letter(ord(g[0])), 2) * np.roll(letters.letter(ord(g[1])), 1) * letters.letter(ord(g[2]))
            total += v * (grams.count(g) ** 0.5 if root else grams.count(g))
        return total

    want = {"aa": bundle(texts[0][1]) + bundle(texts[1][1]), "bb": bundle(texts[2][1])}
    (got,) = lang.learn_prototypes(df)
    assert {k: list(map(int, v)) for k, v in want.items()} == got
    for r in lang.predict(df, got).collect():
        if r.text is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = bundle(r.text, True)
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in want.items()}
        assert r.lang_pred == max(sorted(cos), key=cos.get) and abs(r.score - max(0, max(cos.values()))) < 1e-6


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "aa") for i, t in ODD] + [(50, "words of text", "bb"), (51, "123 %", None), (52, "words", None)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in lang.identify(docs).collect()}
    assert {(1, "und"), (None, "und"), (51, "und")} <= got and (3, "und") not in got
    none = lang.identify(docs.filter("lang is null"))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert lang.identify(docs.limit(0)).count() == 0
    clash = lang.predict(docs.withColumn("SCORE", docs.doc_id), {"aa": [1] * 1024})
    assert clash.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_sql_says_the_same(spark, sf_dir):
    from conftest import held_against_sql

    from lodestone.llm import catalog

    for name in ("op2_warc_merge", "op3_feistel_shards", "op5_decontamination"):
        mine, theirs = held_against_sql(spark, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])
        assert mine == theirs, name

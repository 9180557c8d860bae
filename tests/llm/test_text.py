import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import leakage, mixing, pii, pii_made, pii_tokens, pii_windows, tagger
from quillon.llm.words import Words
from tests.llm import heldout

PASSAGE = "Nobody at the orchard saw the plumber who lifts the tin whistle on a windy day with 543 grams left near the wall"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, lsh_key string, edits int")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, passage string")


def test_words():
    w = Words(["The \\emph{Old}~Caf\u00c9 \\\\Next \\alpha2 a\u2014b", "", "x\\", "\u00dcber"])
    assert [w.spell(i, 1) for i in range(len(w.hash))] == ["the", "old", "caf\u00e9", "next", "2", "a", "b", "x", "\u00fcber"]
    assert w.text.tolist() == [0] * 7 + [2, 3]
    assert Words(["Old caf\u00e9"]).hash.tolist() == w.hash[1:3].tolist()
    assert len(Words([]).hash) == 0 and len(Words(["", " "]).hash) == 0


def leaked(spark, texts, rows=((7, PASSAGE), (8, "too short"), (9, None), (None, PASSAGE)), **options):
    return sorted((r.doc_id, r.item_id, r.edits) for r in leakage.leaks(docs(spark, texts), items(spark, list(rows)), **options).collect())


def test_leaks_exactly_thirteen_words(spark):
    words = PASSAGE.split()
    texts = [
        "x " + " ".join(words[2:15]) + " y", " ".join(words[2:14]) + " other", "%" + "\r\n% ".join(words[:13]).upper(), "~".join(words[5:]), None, "", "\\emph{" + "} \\emph{".join(words) + "}",
        " ".join(words[:12]) + " slowly " + " ".join(words[12:]) if False else " ".join(words[:8]) + " slowly " + " ".join(words[8:16]), "filler " * 20000 + PASSAGE, PASSAGE + " " + PASSAGE,
    ]
    assert leaked(spark, texts) == [(0, 7, 0), (2, 7, 0), (3, 7, 0), (6, 7, 0), (8, 7, 0), (9, 7, 0)]
    assert leaked(spark, texts, broadcast_bytes=1) == leaked(spark, texts)


def test_leaks_of_empty_tables_and_repeats(spark):
    assert leaked(spark, []) == [] and leaked(spark, [PASSAGE], rows=()) == []
    twice = docs(spark, [PASSAGE]).union(docs(spark, [PASSAGE]))
    assert leakage.leaks(twice, items(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)])).count() == 2


def test_near_leak_recall(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(60)]
    texts = []
    for _, p in rows:
        w = p.split()
        at = rng.randint(4, 9)
        w[at] = rng.choice(vocabulary)
        texts.append(" ".join(w[:13]))
    got = {(d, i) for d, i, e in leaked(spark, texts, rows, edits=1)}
    assert sum((k, k) in got for k in range(60)) >= 54


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_leaks_with_replaced_inserted_and_deleted_words(spark, edits):
    """Against brute force over all runs of words: 0.95 of the pairs, and never a wrong distance."""
    rng = random.Random(edits)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(16))) for k in range(40)]
    texts = []
    for _, p in rows:
        w = p.split()[:13]
        for _ in range(edits):
            at = rng.randint(1, len(w) - 2)
            kind = rng.choice(["replace", "insert", "delete"])
            w[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.choice(vocabulary)]
        texts.append("some words before " + " ".join(w) + " and some behind")
    best = {}
    for d, text in enumerate(texts):
        words = text.split()
        for i, p in rows:
            q = p.split()
            runs = [words[a : a + n] for n in range(13 - edits, 14 + edits) for a in range(len(words) - n + 1)]
            least = min(leakage.word_edits(x, q[b : b + 13], edits) for x in runs for b in range(4))
            if least <= edits:
                best[d, i] = least
    got = {(d, i): e for d, i, e in leaked(spark, texts, rows, edits=edits)}
    assert len(best) >= 40 and set(got) <= set(best) and all(got[k] >= best[k] for k in got)
    assert sum(got.get(k) == e for k, e in best.items()) >= 0.95 * len(best)


def test_one_inserted_or_deleted_word(spark):
    words = PASSAGE.split()
    texts = [" ".join(words[:13]), " ".join([*words[:6], "slowly", *words[6:13]]), " ".join([*words[:6], *words[7:13]]), " ".join([*words[:6], "slowly", *words[7:13]])]
    assert leaked(spark, texts, edits=1) == [(0, 7, 0), (1, 7, 1), (2, 7, 1), (3, 7, 1)]


def test_bitmaps_grow_with_the_index():
    small, large = leakage.Bitmap(16), leakage.Bitmap(22)
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    for bitmap in (small, large):
        bitmap.add(hashes[:2000])
        assert bitmap.has(hashes[:2000]).all()
    assert large.has(hashes[2000:]).mean() < small.has(hashes[2000:]).mean() < 0.1


def test_walk_maps_edits_to_few_differences():
    walk = leakage.WalkHash(13, 1)
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 62, (500, 13), dtype=np.uint64)
    b = a.copy()
    b[np.arange(500), rng.integers(0, 13, 500)] = rng.integers(1, 1 << 62, 500, dtype=np.uint64)
    hits = (walk.keys(a) == walk.keys(b)).any(axis=1).mean()
    assert hits >= 0.9 and (walk.keys(a) == walk.keys(a)).all()


def test_splitting_tree_is_exact():
    blocks = np.array([1000, 0, 37, 512])
    dealt = mixing.splitting_tree(blocks, 7, 3)
    assert (dealt.sum(axis=0) == blocks).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3
    assert (dealt == mixing.splitting_tree(blocks, 7, 3)).all()
    assert (mixing.splitting_tree(np.array([0]), 3, 1) == 0).all()


def test_quotas():
    have, goal = {"a": 1000, "b": 100}, {"a": (50, 1), "b": (25, 4), "gone": (25, 9)}
    q = mixing.plan_quotas(have, goal)
    assert q["b"] == 400 and abs(q["a"] - 800) <= 1
    q = mixing.plan_quotas(have, goal, 1300)
    assert q == {"b": 400, "a": 900}
    assert mixing.plan_quotas({}, goal) == {}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "a" if i < 300 else "b", rng.randint(50, 150)) for i in range(340)] + [(900, None, 50), (901, "zzz", 50), (902, "a", 0)]
    sizes = spark.createDataFrame([*rows, rows[0]], "doc_id long, source string, tokens long")
    goal = spark.createDataFrame([("a", 60.0, 1), ("b", 40.0, 5), ("none", 5.0, 2), (None, 1.0, 1)], "source string, target_pct double, max_repeats int")
    draws, shares = mixing.mixture(sizes, goal, block_tokens=500, shard_tokens=4000)
    got = draws.collect()
    assert len({(r.doc_id, r.use) for r in got}) == len(got)
    by = {r.source: r for r in shares.collect()}
    assert abs(by["a"].actual_pct - 60) < 1 and by["b"].most_uses <= 5 and by["a"].most_uses == 1 and by["none"].tokens == 0
    for shard in {r.shard for r in got}:
        assert sorted(r.place for r in got if r.shard == shard) == list(range(1, 1 + sum(r.shard == shard for r in got)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(sizes, goal, block_tokens=500, shard_tokens=4000)[0].collect()))
    assert mixing.mixture(sizes.limit(0), goal)[0].count() == 0


def test_token_counts(spark):
    if not __import__("os").path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer files")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(docs(spark, ["hello world", "", None, "a <|endoftext|> b"]).withColumn("source", F.lit("s"))).collect()}
    assert got[0] == 2 and got[1] == 0 and got[2] == 0 and got[3] > 3


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.start(5).items()}
    symbols, tags = rng.integers(1, 90, (7, 3)), rng.integers(0, tagger.TAGS, (7, 3))
    symbols[5:, 2] = 0
    _, grad = tagger.loss_and_gradient(p, symbols, tags)
    for name in ("ub", "xf", "bf", "e", "t"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        moved = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            moved.append(tagger.loss_and_gradient(q, symbols, tags)[0])
        assert abs((moved[0] - moved[1]) / 2e-3 - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


def test_windows_overlap_and_cover():
    for a, b in ((0, 50), (10, 500), (3, 99 + 3)):
        w = list(pii_windows.cuts(a, b))
        assert w[0][0] == a and w[-1][1] == b and all(y[0] <= x[1] - pii_windows.OVERLAP + 1 for x, y in zip(w, w[1:], strict=False))


TEXT = (
    "\\author{Greta Kolinsk\\and\nVormoor, Omar}\n\\email{greta.kolinsk@maths.neumouth.invalid}\n\\thanks{Phone +49 (0)30 23125 018}\n\\address{83 Saffron Close \\\\ 25185 Ravenswick}\n"
    "We checked the flow against revision 35068@trunk. The Ulvander relation holds. See ISBN 978-0-050-52080-8.\n% TODO ask Peter\n% Zelric about this. The consent form lists SSN 922 77 8896 for the second volunteer.\n"
    "Samples were prepared by Mr. Mark Nernik at noon. Write to anna_bern [at] cs dot valby dot example today.\n\\begin{thebibliography}{1}\n\\bibitem{x} S.~Sandinsk and Leila Fenwick, \\emph{On it}, J. \\textbf{3}, 1674--1978 (1982).\n\\end{thebibliography}"
)


def test_found_and_masked(spark):
    got = {(r.line_no, r.pii_type) for r in pii.find(docs(spark, [TEXT, None, "", "plain"])).collect()}
    assert got == {(1, "name"), (2, "name"), (3, "email"), (4, "phone"), (5, "address"), (7, "name"), (8, "id_number"), (9, "name"), (9, "email")}
    rows = {r.doc_id: r for r in pii.mask(docs(spark, [TEXT, None, "", "plain"]), out_col="edits").collect()}
    masked = rows[0].edits
    for gone in ("Kolinsk", "Omar", "Peter", "greta.", "23125 018", "Saffron", "922 77", "Mark", "anna_bern"):
        assert gone not in masked
    for kept in ("35068@trunk", "Ulvander", "978-0-050-52080-8", "S.~Sandinsk and Leila Fenwick", "Mr. [NAME]", "\\email{[EMAIL]}", "SSN [ID_NUMBER]"):
        assert kept in masked
    assert masked.count("\n") == TEXT.count("\n") and rows[1].edits is None and rows[2].edits == "" and rows[3].edits == "plain"


def test_very_long_text_and_empty(spark):
    long = "The crystal is slow. " * 50_000 + "Write to nadia60@mail.steinmouth-uni.test please.\n" + "x" * 200_000
    assert [(r.line_no, r.pii_type) for r in pii.find(docs(spark, [long])).collect()] == [(1, "email")]
    assert pii.find(docs(spark, []).select("doc_id", "text")).count() == 0


def invented(rng):
    word = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouy") for _ in range(rng.randint(1, 2)))
    return (word + rng.choice("n r s t l k m d ck nd rt va na ski ez son ra".split())).capitalize()


def test_held_out_accuracy():
    """On invented surroundings the tagger never saw: names and mailboxes made up here."""
    rng = random.Random(77)
    hits = total = 0
    for _ in range(200):
        name = f"{rng.choice(pii_made.GIVEN)} {invented(rng)}"
        text = f"We thank {name} for help with the signal. Unlike earlier work, our lattice follows the graph."
        total += 1
        hits += any(k == "name" and text[a:b] == name for _, a, b, k in pii.spans([text]))
    assert hits / total > 0.7


def test_held_out_sentences():
    """Sentences and items written by hand: exact ends of each kind, and the windows' own recall."""
    cases = heldout.cases()
    assert len(cases) >= 500
    found = {}
    for k, a, b, kind in pii.spans([c[0] for c in cases]):
        found.setdefault(k, []).append((a, b, kind))
    for kind in tagger.KINDS:
        mine = [(k, a, b) for k, (_, a, b, x) in enumerate(cases) if x == kind]
        hits = sum((a, b, kind) in found.get(k, []) for k, a, b in mine)
        wrong = sum(x == kind and (a, b, x) != cases[k][1:] for k, spans in found.items() for a, b, x in spans)
        assert hits / len(mine) >= 0.9 and hits / (hits + wrong) >= 0.9, (kind, hits, len(mine), wrong)
    _, places = pii_windows.windows([c[0] for c in cases])
    inside = [any(k == i and a <= s and e <= b for k, a, b in places) for i, (_, s, e, _) in enumerate(cases)]
    # A window may end inside a long item; overlapping windows then cover it together.
    by_char = [all(any(k == i and a <= c < b for k, a, b in places) for c in range(s, e)) for i, (_, s, e, _) in enumerate(cases)]
    assert np.mean(by_char) >= 0.99 and np.mean(inside) >= 0.9
    assert len(pii.spans(heldout.PLAIN)) <= 0.15 * len(heldout.PLAIN)


def covered(text, *items):
    """Whether a window holds each item whole, whatever the tagger makes of it."""
    _, places = pii_windows.windows([text])
    return all(any(a <= text.index(x) and text.index(x) + len(x) <= b for _, a, b in places) for x in items)


def test_names_behind_sentence_openers():
    openers = "The In At For If Here No Let Both Why Unlike Following We It This Nach Selon Für Para Die On Department University".split()
    for opener in openers:
        for name in ("Anna Kowalska", "Greta Fenwick"):
            assert covered(f"the lattice is slow and follows the graph. {opener} {name} the signal was read again and again", name)
    for text in ("For Kowalska, Anna it was", "In Ludwig van Kowalska we saw", "Both Anna\n% Kowalska and", "If Anna J. Kowalska is", "Para Jos\\'e \\'Alvarez es"):
        assert covered(f"the lattice is slow. {text} again", text.split(" ", 1)[1].rsplit(" ", 1)[0])
    hits = [any(k == "name" and "Anna Kowalska" in t[a:b] for _, a, b, k in pii.spans([t])) for t in (f"It was slow. {o} Anna Kowalska, the signal was read again." for o in ("In", "At", "For", "If", "Unlike", "Following", "On", "Department"))]
    assert np.mean(hits) > 0.7
    assert pii.spans(["It was slow. The Voraya--Ramier relation holds."]) == []


def test_short_accented_and_foreign_names_reach_the_tagger():
    names = ["Wei Li", "Yuki Ito", "J. Lee", "J.~Wu", "Li, Wei", "Jos\\'e Garc\\'ia", "\\'Elise \\'Alvarez", "Pavel \\v{S}imek", "Piotr\\,Kowalska", "Anna\\;Fenwick", "A.\\ Xu", "Anna\r\n%Li", "Łukasz Šimek", "Šárka Žižková", "Ludwig van Kowalska", "Kowalska J."]
    hits = 0
    for name in names:
        text = f"the lattice is slow and follows the graph. We thank {name} for help with the signal"
        assert covered(text, name)
        at = text.index(name)
        hits += any(k == "name" and a < at + len(name) and b > at for _, a, b, k in pii.spans([text]))
    assert hits / len(names) > 0.7
    assert pii._sound("name", "Łukasz Šimek") and not pii._sound("name", "Łukasz")


def test_long_groups_of_mailboxes():
    people = "anna.kolinsk bruno.lindescu carmen.zelwick david.tarnholt elif.ramsand greta.fenwick hugo.vormoor ines.corberg jean.halholt karim.melstone lars.nerdahl maeve.oswick".split()
    for opening, closing in (("{", "}"), ("\\{", "\\}")):
        for between in (", ", ",\n"):
            for n in (2, 6, 12):
                item = opening + between.join(people[:n]) + closing + "@maths.x.test"
                text = f"The lattice is slow and follows the graph. Contact {item} for the data."
                assert [text[a:b] for *_, a, b, _ in pii.spans([text])] == [item]
                assert pii.mask_texts([text]) == ["The lattice is slow and follows the graph. Contact [EMAIL]" + "\n" * item.count("\n") + " for the data."]
    assert pii_windows.group("\\texttt{anna}@x.test", 13) == 13 and pii_windows.group("}@", 1) == 1 and pii_windows.group("a@", 1) == 1


def test_bibliographies_hold_all_kinds_but_names():
    entry = "\\begin{thebibliography}{1}\n\\bibitem{x} S.~Sandinsk and Leila Fenwick, \\emph{On it}, J. \\textbf{3}, 1674--1978 (1982). %s\n"
    for item, kind in (("Phone +49 (0)30 23125 018", "phone"), ("The consent form lists SSN 922 77 8896", "id_number"), ("Write to anna_bern [at] cs dot valby dot example today.", "email"), ("P.O. Box 12, 25185 Ravenswick", "address")):
        for end in ("\\end{thebibliography}", "The text goes on."):
            text = entry.replace("%s", item + " for the data.") + end
            assert [k for *_, k in pii.spans([text])] == [kind], (item, end)


def test_the_tagger_reads_every_character():
    texts = ["the lattice is slow and $x_{i}^{2} = 3.5$ follows \\emph{the graph}, \u65e5\u672c \u00abd\u00e9j\u00e0\u00bb \\\\ (see 4).\n" * 300, "", "plain words only", " \n", "x" * 5000]
    _, places = pii_windows.windows(texts)
    for k, text in enumerate(texts):
        seen = np.zeros(len(text), bool)
        for _, a, b in (p for p in places if p[0] == k):
            seen[a:b] = True
        assert all(seen[i] for i, c in enumerate(text) if not c.isspace())
    assert sum(p[0] == 0 for p in places) > 1


def test_tokens_of_pieces_and_items_on_the_edges_of_windows(monkeypatch):
    text = "the lattice is slow. Write to {anna, bruno}@maths.x.test \\emph{12.5} 1234567\n\n" * 20
    types = pii_tokens.Types(np.zeros(0, np.uint32))
    whole = pii_tokens.tokens(text, types).tolist()
    for size in (1, 7, 50):
        monkeypatch.setattr(pii_tokens, "PIECE", size)
        assert pii_tokens.tokens(text, types).tolist() == whole
    word, item = "the lattice is slow and follows the graph of it. ", "anna.kolinsk@maths.x.test"
    for n in range(36, 60):
        text = word * n + f"Write to {item} today. " + word * 60
        assert [(text[a:b], kind) for _, a, b, kind in pii.spans([text])] == [(item, "email")], n


def test_fast_states_and_paths_are_right():
    rng = np.random.default_rng(1)
    p, symbols = tagger.start(5), rng.integers(1, 90, (3, 6))
    symbols[2:, 4] = 0
    for d in "fb":
        assert np.allclose(2 * tagger._run(p, symbols, d, False)[0], tagger._states(p, symbols, d), atol=1e-5)
    e, paths = tagger.emissions(p, symbols), tagger.decode(p, symbols)
    for n in range(6):
        score = e[0, n][:, None, None] + e[1, n][:, None] + e[2, n] + p["t"][:, :, None] + p["t"]
        assert tuple(paths[:, n]) == np.unravel_index(score.argmax(), score.shape)

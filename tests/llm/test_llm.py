"""Operators for training text: hand-made cases, brute force and round trips."""

import itertools
import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notarium.llm import markup, mixing, near_duplicates, rank_fusion, splitting, tokenizer, truncation

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


# --- markup ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("plain a == b and 3 > 0 (R&D) $4 to $83 C:\\31 a[9] #tag #56 in line ~40% {x} [sic] x -> y 2 * 3 * 4 snake_case_name", []),
        ("a [^7] b", ["markdown"]), ("- [ ] todo", ["markdown"]), ("> said", ["markdown"]), ("~~a~~", ["markdown"]), ("Head\n====\n", ["markdown"]),
        ("| a | b |\n|---|:-:|", ["markdown"]), ("`<b>`", ["markdown"]), ("```\n<b>x</b> [[y]]\n```", ["markdown"]), ("~~~\nopen \\section{x}", ["markdown"]),
        ("[[a|b]]", ["wiki"]), ("{{cite|x}}", ["wiki"]), ("a ''b'' c", ["wiki"]), ("== Head ==", ["wiki"]), ("{| class=x\n|-\n| a || b\n|}", ["wiki"]),
        ("<i>open", ["html"]), ("a<br/>b", ["html"]), ("&nbsp;", ["html"]), ("<!-- x\ny -->", ["html"]), ("<!DOCTYPE html>", ["html"]), ("<pre>## a [[b]] \\c</pre>", ["html"]),
        ("\\emph{x}", ["latex"]), ("66\\%", ["latex"]), ("$x_i^{3}$", ["latex"]), ("\\begin{align}\na_b *c* d\n\\end{align}", ["latex"]),
        ("---\ntitle: \"*x* [[y]]\"\n---\ntext", []), ("", []), ("   ", []), ("a <b and c> d", ["html"]), ("AT&T; x", []),
    ],
)
def test_families(text, want):
    assert markup.clean(text)[1] == want


def test_clean_text_keeps_structure():
    text = "---\na: b\n---\n# Head *one*\n\n* item [x](y)\n\n```py\nz = '**'\n```\n\nSee $a_b$ and `c_d`.\n\n<h2>Sub</h2><ul><li>q</li></ul>\n\n== Wiki ==\n\n\\section{Tex} ''it''"
    out = markup.clean(text)[0]
    assert out.startswith("# Head one\n\n- item x\n\n```\nz = '**'\n```\n\nSee $a_b$ and c_d.")
    assert "## Sub\n" in out and "- q" in out and "## Wiki" in out and out.endswith("# Tex it")
    assert markup.clean(None) == (None, [], 0, 0)


def test_every_fence_is_masked():
    text = "---\na: b\n---\nx\n\n```\n[[a]]\n```\n\ny\n\n~~~sql\n```\n<b>\n~~~\n\nz\n\n````\n$a$\n````\nend"
    out, found, *_ = markup.clean(text)
    assert found == ["markdown"] and "[[a]]" in out and "<b>" in out and "$a$" in out and out.endswith("end")


def test_chrome_is_dropped_from_pages():
    page = "<html><body>\n\nok\n\n\n\n" + "\n".join(f"<p>{prose(i, 20)}</p>" for i in range(4)) + "\n\n\n\n\nx\n\n</body></html>"
    out = markup.clean(page)[0]
    assert "ok" not in out.split("\n") and "x" not in out.split("\n") and prose(0, 20) in out


def test_chrome_around_content_goes_and_its_parts_stay():
    nav = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li>Contact</li></ul>\n<p>Home | Login</p>\n"
    foot = "<footer><ul><li>Imprint</li><li>Privacy</li></ul>(c) 2025</footer></body></html>"
    body = (
        f"<h1>On rivers</h1><p>{prose(1, 40)}.</p>\n<ul><li>one oak</li><li>two elms</li></ul>\n<p>{prose(2, 40)}.</p><h2>Code</h2><pre>x = 1\ny = 2</pre>"
        f"<p>{prose(3, 30)} $a_b$.</p><table><tr><td>k</td><td>1</td></tr>\n<tr><td>m</td><td>2</td></tr></table><p>{prose(4, 30)}.</p>"
    )
    out = markup.clean(f"<html><body><nav>{nav}</nav>{body}{foot}")[0]
    for gone in ("Home", "About", "Contact", "Login", "Imprint", "Privacy", "(c) 2025"):
        assert gone not in out
    assert out.startswith("# On rivers") and out.endswith(prose(4, 30) + ".")
    for kept in ("- one oak\n- two elms\n", "## Code", "```\nx = 1\ny = 2\n```", "$a_b$", "k\t1\nm\t2"):
        assert kept in out


def test_short_parts_at_the_rims_of_a_page_stay():
    text = f"---\na: b\n---\n# Head\n\n<p>{prose(1, 40)}.</p>\n\n## Code\n\n```\nx\n```\n"
    assert markup.clean(text)[0] == f"# Head\n\n{prose(1, 40)}.\n\n## Code\n\n```\nx\n```"
    box = "{| class=x\n|-\n| k || v\n|}\nspan = 4 metres\nmade = in 1901\nname = Old bridge\n"
    out = markup.clean(f"{box}\n<p>{prose(2, 40)}</p>\n\\begin{{tabular}}{{ll}}\na & b \\\\\nc & d \\\\\ne & f \\\\\n\\end{{tabular}}\n")[0]
    assert "span = 4 metres" in out and "a\tb" in out and "e\tf" in out


def test_runs_of_links_inside_go():
    links = "".join(f"<p><a href='/{i}'>Read more {i}</a></p>" for i in range(5))
    out = markup.clean(f"<div><p>{prose(1, 40)}</p>{links}<p>{prose(2, 40)}, see <a href='x'>the map</a>.</p></div>")[0]
    assert "Read more" not in out and "see the map." in out


def test_list_items_stand_on_their_own_lines():
    assert markup.clean("<ul><li>one</li><li>two</li></ul>")[0] == "- one\n- two"
    assert markup.clean("<ol>\n<li>one</li>\n<li>two <b>x</b></li>\n</ol>")[0] == "- one\n- two x"


@pytest.mark.parametrize("marks", [("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("\\begin{align*}", "\\end{align*}")])
def test_formulas_of_any_length_are_kept(marks):
    formula = marks[0] + "x + \\alpha \\frac{a}{b}" * 3000 + marks[1]
    out, found, *_ = markup.clean(f"Before {formula} and \\emph{{after}}.")
    assert formula in out and out.endswith("and after.") and found == ["latex"]


def test_unclosed_formulas_are_none():
    assert markup.clean("It costs $$ a lot")[1] == [] and markup.clean("a \\[ b\n\nc \\] d")[0] == "a \\[ b\n\nc \\] d"


def test_residue_blocks_surge_and_dive():
    assert markup.residue_blocks([(2, 5), (4, 1), (9, 3)]) == [(2, 4, 6), (9, 9, 3)] and markup.residue_blocks([]) == []
    assert markup.text_blocks([0, 3, 200, 180, 0, 0, 0, 4, 0, 150, 2, 0, 0]) == [(2, 3), (9, 9)]


def test_long_texts_are_linear():
    for text in ("a" * 200_000, "[" * 50_000, "$ " * 50_000, "*" * 50_000, "<" * 50_000, ("word " * 10 + "\n") * 5_000, "_a " * 30_000, "\\[ " * 50_000, "$$\n\n" * 50_000, "\\begin{align}" * 20_000, "<li>" * 30_000):
        markup.clean(text)


def test_found_families(spark):
    df = spark.createDataFrame([("t", 1, "# a [[b]]", 0), ("t", 1, "# a [[b]]", 0), ("t", 2, None, 0), ("t", 3, "", 0)], "source_table string, record_id bigint, text string, markup int")
    assert sorted(map(tuple, markup.found_families(df).collect())) == [("t", 1, "markdown"), ("t", 1, "wiki")]
    assert markup.strip_markup(df.limit(0)).count() == 0


# --- rank fusion ----------------------------------------------------------------------------------

HITS = "hit_id bigint, query_id bigint, point_id string, title_score double, keyword_score double, semantic_score double, score double, session_effective_score double, searched_at timestamp, place string"


def test_leaders_and_ranking(spark):
    t, nan = datetime(2025, 1, 1), float("nan")
    data = [
        (1, 1, "a", 9.0, 9e9, 0.9, 0.1, nan, t, ""), (2, 1, "b", 1.0, 1.0, 0.5, 0.2, 0.3, t, ""), (3, 1, "c", 0.5, 0.5, 0.4, 0.0, 0.1, t, ""),
        (4, 1, "a", 0.0, 0.0, 0.0, 0.0, 0.0, datetime(2024, 1, 1), ""), (1, 1, "a", 9.0, 9e9, 0.9, 0.1, nan, t, ""),
        (5, 2, "x", None, None, None, None, None, t, ""), (6, None, "y", 1.0, 1.0, 1.0, 1.0, 1.0, t, ""), (7, 3, "z", 1.0, 1.0, 1.0, 1.0, float("inf"), None, ""),
    ]
    df = spark.createDataFrame(data, HITS)
    assert sorted(map(tuple, rank_fusion.leaders(df).collect())) == [(1, "a"), (3, "z")]
    got = {(r["query_id"], r["point_id"]): r for r in rank_fusion.ranking(df).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "x"), (3, "z")}
    assert got[2, "x"]["significance"] == 1.0 and got[1, "a"]["place"] == 1
    assert rank_fusion.ranking(df.limit(0)).count() == 0


def test_wide_queries_agree_with_narrow_ones(spark):
    r = random.Random(8)
    data = [
        (i, i % 3, f"p{r.randrange(60)}", *[r.choice([None, float("nan"), float(r.randrange(9)), r.random()]) for _ in range(5)], datetime(2025, 1, 1 + i % 9), "")
        for i in range(400)
    ]
    data += [(1000 + q, q, "best", 10.0, 10.0, 10.0, 10.0, None, datetime(2026, 1, 1), "") for q in range(3)]
    df = spark.createDataFrame(data, HITS)
    for run in (rank_fusion.ranking, rank_fusion.leaders):
        narrow, wide = (sorted(map(tuple, run(df, wide=w).collect())) for w in (10_000, 0))
        assert narrow == wide and narrow
    columns = ["query_id", "point_id", "present", "firsts", "upper", "significance"]
    found = rank_fusion.aggregate(df).select(*columns)
    exact = found.where("present >= 4 AND firsts >= 3 AND upper = present").select("query_id", "point_id")
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, rank_fusion.leaders(df).collect()))


def test_significance_is_the_binomial_tail(spark):
    from math import comb

    ranks = [0.1, 0.4, 0.4, 0.9]
    tails = [sum(comb(4, i) * r**i * (1 - r) ** (4 - i) for i in range(k, 5)) for k, r in enumerate(sorted(ranks), 1)]
    got = spark.createDataFrame([(ranks,), ([],)], "r array<double>").select(rank_fusion.significance(F.col("r")).alias("s")).collect()
    assert got[0]["s"] == pytest.approx(min(1, 4 * min(tails))) and got[1]["s"] == 1.0


def test_scale_does_not_matter(spark):
    r = random.Random(4)
    data = [(i, 1, f"p{i}", r.random(), r.random(), r.random(), r.random(), None, None, "") for i in range(30)]
    df = spark.createDataFrame(data, HITS)
    big = df.withColumn("keyword_score", F.exp(F.col("keyword_score") * 50) * 1e6)
    assert sorted(map(tuple, rank_fusion.ranking(df).collect())) == sorted(map(tuple, rank_fusion.ranking(big).collect()))


# --- splitting ------------------------------------------------------------------------------------


def test_pieces_keep_limits_and_lose_nothing():
    for seed, limit, overlap in [(1, 50, 7), (2, 20, 0), (3, 10, 30), (4, 1, 0), (5, 3, 2)]:
        r = random.Random(seed)
        text = "".join(w + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "\n\n## H\n"]) for w in prose(seed, 400).split())
        spans, pieces = splitting.cuts(text, limit, overlap)
        assert all(b - a <= limit for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(spans)
        own = min(overlap, limit - 1)
        for (_, end), (begin, _) in zip(pieces, pieces[1:]):
            assert begin == max(0, end - own)


def test_cuts_prefer_natural_boundaries():
    text = "\n\n".join(prose(i, 30) + "." for i in range(10))
    spans, pieces = splitting.cuts(text, 80, 0)
    assert all(text[spans[b - 1][1] - 1] == "." for _, b in pieces)


def test_edits_move_only_neighbours():
    changed = []
    for seed in range(40):
        base = [prose(1000 * seed + i, 12) + "." for i in range(120)]
        edited = base[:60] + ["some new words here."] + base[60:]

        def parts(sentences):
            text = " ".join(sentences)
            spans, pieces = splitting.cuts(text, 60, 0)
            return {text[spans[a][0] : spans[b - 1][1]] for a, b in pieces}

        before, after = parts(base), parts(edited)
        changed.append(len(before - after))
    assert sorted(changed)[20] <= 1 and max(changed) <= 4


def test_landmarks_roll():
    r = random.Random(3)
    codes = [r.getrandbits(32) for _ in range(500)]
    whole = []
    for i in range(1, 501):
        rolled = 0
        for code in codes[max(0, i - splitting.ROLL) : i]:
            rolled = (rolled * 1_000_003 + code) % 2**32
        if rolled % splitting.EVERY == 0:
            whole.append(i)
    assert splitting.landmarks(codes) == whole


def test_sections_and_fences():
    text = "pre\n```\n# no\n````\n# one\n~~~~\n## no\n~~~\n~~~~\n##no\n## two words\nx"
    assert [(n, p) for n, p, _ in splitting.sections(text)] == [(0, ""), (1, "one"), (2, "one > two words")]
    assert "\n".join(s for _, _, s in splitting.sections(text)) == text


def test_split_oversized(spark):
    notes = spark.createDataFrame([(1, 1, "# A\n" + prose(1, 50), "x"), (2, 9, prose(2, 50), "x"), (3, 1, None, "x"), (4, None, "", "x")], "id bigint, collection_id bigint, markdown_text string, limit string")
    chunks = spark.createDataFrame(
        [(10, 1, "H", prose(3, 30)), (10, 1, "H", prose(3, 30)), (11, 1, None, "few"), (12, 77, None, prose(4, 99)), (13, None, None, prose(4, 99)), (14, 1, None, None)],
        "id bigint, document_id bigint, heading_path string, text_content string",
    )
    limits = spark.createDataFrame([(1, 20, 5), (2, None, 5), (None, 3, 1)], "collection_id bigint, max_words int, overlap_words int")
    got = splitting.split_oversized(notes, chunks, limits).collect()
    assert {(r["source_table"], r["record_id"], r["section_no"]) for r in got} == {("vq_documents", 1, 1), ("vq_chunks", 10, 0)}
    assert all(r["token_count"] == len(r["text"].split()) <= 20 for r in got) and len({(r["record_id"], r["piece_no"]) for r in got}) == len(got)
    assert splitting.split_oversized(notes, chunks, limits.limit(0)).count() == 0
    assert splitting.split_oversized(notes.limit(0), chunks.limit(0), limits).count() == 0


# --- near-duplicates ------------------------------------------------------------------------------


def brute(texts, k, least, threshold):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {
        (a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and sets[a] | sets[b]
    }


def corpus(seed, groups=25):
    r = random.Random(seed)
    out, i = [], 0
    for g in range(groups):
        base = prose(1000 * seed + g, r.choice([25, 60, 150])).split()
        for _ in range(r.choice([1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
            if r.random() < 0.2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            out.append((i, " ".join(w).upper() if r.random() < 0.2 else ", ".join(w)))
            i += 1
    return out + [(i, None), (i + 1, ""), (i + 2, "too short")]


@pytest.mark.parametrize("seed, k, threshold, small", [(1, 3, 0.6, 64), (2, 5, 0.8, 64), (3, 3, 0.6, 2)])
def test_pairs_against_brute_force(spark, seed, k, threshold, small):
    texts = corpus(seed)
    rows = [(0, i, t, "x") for i, t in texts] + [(0, None, texts[0][1], "x"), (0, *texts[0], "x")] + [(1, *texts[0], "x")]
    df = spark.createDataFrame(rows, "scope int, id bigint, text string, n string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text", threshold, k, 20, small=small)
    got = [(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, k, 20, threshold)


def test_common_shingles_do_not_hide_pairs(spark):
    shared = prose(7, 30)
    texts = [(i, f"{shared} {prose(100 + i // 2, 40)}" + (" tail" if i % 2 else "")) for i in range(60)]
    df = spark.createDataFrame([(0, i, t) for i, t in texts], "scope int, id bigint, text string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text", 0.8, 5, 20, small=4)
    assert {(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs).collect()} == brute(texts, 5, 20, 0.8)


def test_hot_families_lose_no_pairs(spark):
    """Passages of one long text: all that a pair shares is shared by many others of its family too."""
    r = random.Random(11)
    texts, want = [], set()
    for family in range(60):
        base = [f"f{family}w{j}" for j in range(152)]
        own = []
        for _ in range(30):
            at, size = r.randrange(60), r.randrange(55, 152)
            own.append((len(texts) + len(own), " ".join(base[at : at + size])))
        texts += own
        want |= brute(own, 3, 20, 0.6)
    df = spark.createDataFrame([(0, i, t) for i, t in texts], "scope int, id bigint, text string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text", 0.6, 3, 20, small=4)
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs).collect()}
    assert len(want) > 5000 and got == want


def test_groups_and_large_classes(spark):
    a, b = prose(1, 60), prose(1, 60) + " more"
    texts = [(i, a) for i in range(5)] + [(5, b), (6, prose(2, 60))]
    df = spark.createDataFrame([(0, i, t) for i, t in texts], "scope int, id bigint, text string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text")
    got = {r["id"]: (r["class_id"], r["links"]) for r in near_duplicates.groups(members, pairs).collect()}
    assert got == {i: (0, 5) for i in range(6)}
    star = {(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs, expand=3).collect()}
    assert star == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)}
    empty = near_duplicates.similar(df.limit(0), "scope", "id", "text")
    assert near_duplicates.all_pairs(*empty).count() == 0 and near_duplicates.groups(*empty).count() == 0


def test_membership_completes_the_star(spark):
    a = prose(1, 60)
    texts = [(0, a), (1, a.upper()), (2, a), (3, a), (4, a), (9, prose(2, 60)), (10, "short")]
    df = spark.createDataFrame([(0, i, t) for i, t in texts], "scope int, id bigint, text string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text", 0.6, 3)
    rows = near_duplicates.membership(members).collect()
    assert {(r["id"], r["class_id"], r["class_size"], r["copy_of"]) for r in rows} == {(0, 0, 5, 0), (1, 0, 5, 1), (2, 0, 5, 0), (3, 0, 5, 0), (4, 0, 5, 0), (9, 9, 1, 9)}
    star = {(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs, expand=2).collect()}
    lead = {r["id"]: r["copy_of"] for r in rows}
    whole = {(x, y) for x, y in itertools.combinations(range(5), 2) if lead[x] == lead[y] or tuple(sorted((lead[x], lead[y]))) in star}
    assert whole == brute(texts, 3, 20, 0.6)


def test_only_exact_copies_are_not_expanded(spark):
    a, b = prose(1, 60), prose(1, 60) + " more"
    texts = [(0, a), (1, a.upper()), (2, a + "!"), (3, a), (4, a), (5, a), (6, b)]
    df = spark.createDataFrame([(0, i, t) for i, t in texts], "scope int, id bigint, text string")
    members, pairs = near_duplicates.similar(df, "scope", "id", "text")
    got = [(r["id_a"], r["id_b"]) for r in near_duplicates.all_pairs(members, pairs, expand=3).collect()]
    differing = {(x, y) for x, y in itertools.combinations([0, 1, 2, 6], 2)}
    assert len(got) == len(set(got)) and set(got) == differing | {(0, 3), (0, 4), (0, 5)}


# --- tokenizer ------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZER_DIR), reason="no vocabularies here")
TEXTS = [
    "", None, " ", "\n\n  x \t", "Hello, world's  end 1234 <|endoftext|>", "naïve façade ñandú", "日本語のテキストを測る。", "🙂👩‍🔧🇺🇳", "a" * 700, "ab" * 900, "　 \x85\x1c x",
    "don't I'LL we've", "x\x00y", "zusammengesetztes Wörterbuch", "http://a.b/c?d=e&f", "الكتاب", "   " * 100 + "end",
]


@needs_vocabulary
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(os.path.join(tokenizer.TOKENIZER_DIR, "byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, None, "x"), (None, "lost id", "x"), (4, TEXTS[4], "x")], "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokenizer.encode(df).collect()]
    want = [(r["doc_id"], coder.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokenizer.encode(df.limit(0)).count() == 0


@needs_vocabulary
def test_long_words_are_folded_exactly(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(os.path.join(tokenizer.TOKENIZER_DIR, "byte_bpe_50k.json"))
    r = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choice(letters) for _ in range(100_000)), "".join(chr(r.randrange(0x3041, 0x3097)) for _ in range(3000)), "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "=" * 300]
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (47, 48, 49, 50, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["ids"] for x in tokenizer.encode(df).collect()}
    assert got == {i: coder.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


@needs_vocabulary
def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode_ids(tokenizer.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


# --- mixing ---------------------------------------------------------------------------------------


def test_rake_meets_targets_and_caps():
    cells = [("a", "en", "x", 100.0), ("a", "de", "y", 300.0), ("b", "en", "y", 50.0), ("c", "en", "x", 5.0), ("d", "en", "x", 1.0)]
    targets = {"a": (0.5, 2), "b": (0.3, 3), "c": (0.1, 5), "none": (0.1, 1)}
    weights = mixing.rake(cells, targets)
    sums = {s: sum(w * t for (a, b, c), w in weights.items() for s2, l, p, t in cells if (a, b, c) == (s2, l, p) and a == s) for s in "abc"}
    total = sum(sums.values())
    assert {s: round(v / total, 4) for s, v in sums.items()} == {"a": 0.5556, "b": 0.3333, "c": 0.1111}
    assert all(w <= targets[a][1] + 1e-9 for (a, _, _), w in weights.items()) and "d" not in {k[0] for k in weights}
    assert mixing.rake([], targets) == {}


@needs_vocabulary
def test_mix(spark):
    data = [(i, prose(i, 20 + i % 17), ["en", "de", "EN", None][i % 4], "ab"[i % 2], "x") for i in range(300)]
    data += [(300 + i, prose(0, 20), "en", "a", "x") for i in range(20)] + [(400, None, "en", "a", "x"), (401, "", "en", "b", "x"), (402, "no target", "en", None, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, tokens string")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.2, 3), ("zzz", 0.1, 1)], "source string, target_share double, max_repeats int")
    picked = mixing.mix(df, targets).collect()
    texts = {i: t for i, t, *_ in data}
    most = {"a": 2, "b": 3}
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in picked)
    assert len({texts[r["doc_id"]] for r in picked}) == len(picked)
    shares = {r["source"]: r["actual_share"] for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert shares["a"] == pytest.approx(7 / 9, abs=0.01) and shares["zzz"] == 0.0
    assert sorted(map(tuple, mixing.mix(df, targets).collect())) == sorted(map(tuple, picked))
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


@needs_vocabulary
def test_topics_and_languages_come_from_the_corpus(spark):
    """On a corpus of made-up words in made-up languages texts of one vocabulary share a topic, and the margins are met."""
    r = random.Random(6)
    vocabularies = [[f"{a}{b}{c}" for b in "aeiou" for c in "kmnprst"] for a in ("zu", "qi", "xo")]
    rows = []
    for i in range(900):
        kind = i % 3
        rows.append((i, " ".join(r.choice(vocabularies[kind]) for _ in range(60)), ["xx", "YY ", "zz" if i == 1 else "xx"][i % 2 if i != 1 else 2], "ab"[i % 7 == 0], "x"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, vector string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    topics = {x["doc_id"]: (x["lang"], x["topic"]) for x in mixing.with_topics(mixing.sized_texts(df), topics=3).collect()}
    kinds = [{topics[i][1] for i in range(kind, 900, 3)} for kind in range(3)]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3
    assert {lang for lang, _ in topics.values()} == {"xx", "yy", "other"} and topics[1][0] == "other"
    for x in mixing.marginals(df, targets).collect():
        assert x["actual_share"] == pytest.approx(x["wanted_share"], abs=0.02), x
    shares = {x["source"]: x["actual_share"] for x in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert shares["a"] == pytest.approx(0.6, abs=0.01)


@needs_vocabulary
def test_topics_are_fitted_on_all_texts(spark):
    """The topics of 12000 texts are those of a plain fit in memory over all of them, whatever the partitions."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("zu", "qi", "xo", "ka") for b in "aeiou" for c in "kmnprst"]
    texts = [" ".join(r.choice(words[20 * (i % 5) : 20 * (i % 5) + 60]) for _ in range(12)) + f" n{i}" for i in range(12000)]
    langs = ["xx" if i % 3 else "yy" for i in range(12000)]
    df = spark.createDataFrame([(i, t, x, "a") for i, (t, x) in enumerate(zip(texts, langs))], "doc_id bigint, text string, lang string, source string")
    sized = mixing.sized_texts(df)
    keys = {x["doc_id"]: (x["k1"], x["k2"]) for x in sized.select("doc_id", "k1", "k2").collect()}
    order = sorted(range(12000), key=keys.get)
    rows = mixing.word_counts(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])).astype(float)
    for x in ("xx", "yy"):
        own = [i for i in range(12000) if langs[i] == x]
        rows[own] -= rows[own].mean(axis=0)
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True))[order]
    centres = rows[:1]
    for _ in range(4):
        centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(axis=1))]])
    for _ in range(30):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[own == j].sum(axis=0) for j in range(5)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    want = {order[at]: f"topic-{t}" for at, t in enumerate(np.argmax(rows @ centres.T, axis=1))}
    got = [{x["doc_id"]: x["topic"] for x in mixing.with_topics(sized.repartition(n), topics=5).collect()} for n in (1, 7)]
    assert got[0] == got[1] and len(set(want.values())) == 5
    assert sum(got[0][i] == want[i] for i in want) >= 0.999 * len(want)  # the fit rounds to steps of 2 ** -20


# --- truncation -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("A whole sentence.", "whole"), ("It ends with a quote.\"", "whole"), ("日本語。", "whole"), ("Said late. To be continued…", "whole"), ("Done.\n\n-- \nDesk 4", "whole"),
        ("Text.\n\n| a | 1 |\n|---|---|\n| b | 2 |", "whole"), ("Text.\n\n```\ncode(\n```", "whole"), ("Text. 🙂", "whole"), ("Text.\n\nhttps://a.b/c", "whole"), ("<p>Text.</p>", "whole"),
        ("Text.\n\n#tag #tag/two", "whole"), ("It said [truncated] in red.", "whole"), ("", "whole"),
        ("The plan was to rewrite the whole of the notebook before the observatory opened and then to vis", "cut"), ("Nobody drafte…", "cut"), ("Nobody dr...", "cut"), ("both felt [...]", "cut"),
        ("It was al [truncated, 23 more characters]", "cut"), ("One orn\n\n[message clipped]", "cut"), ("The pla (continued in the next message)", "cut"), ("each separate-", "cut"),
        ("Then see <a href=\"/sch", "cut"), ("a spores w&am", "cut"), ("Then **foss", "cut"), ("Text.\n\n- ", "cut"), ("Text.\n\n##", "cut"), ("Text.\n\n![", "cut"), ("Text.\n\n```\ncode(", "cut"),
        ("Text.\n\nfeels wove\n\nhttps://a.b/c", "cut"), ("Text.\n\nOhne sie bleibt die Brücke im\n\n-- \nDesk 5", "cut"), ("see x thread", "unsure"), ("古い索引を台所に移し", "cut"), ("¿ Por qu\ufffd", "cut"), ("Ended. It took two attempts to find the way back, mostly separately, with a very old map of\n</body></html>", "cut"),
        ("<ul>\n<li>x</li>\n</ul>\n</body></html>", "whole"), ("<p>So it ends.</p>\n\n</div>", "whole"), ("A whole sentence. [...]", "whole"),
        ("Text.\n\n~~~sql\n```\n\nx = `1\n~~~", "whole"), ("Text.\n\n```\na\n\nb\n```\nThe end.", "whole"), ("Text.\n\n~~~\n```\nx", "cut"),
    ],
)
def test_closings(text, want):
    learnt = frozenset(["[truncated, 0 more characters]", "[message clipped]", "(continued in the next message)"])
    assert truncation.closing(text, learnt)[0] == want


DOCS = "doc_id bigint, text string, source string, cut int"


def test_lists_and_messages_by_terminality(spark):
    whole = [(i, f"Intro here.\n\n- check the dry {n}\n- merge the cold {m}", "n", 0) for i, (n, m) in enumerate(itertools.permutations(["river", "ledger", "lantern", "pantry", "kettle"], 2))]
    chats = [(100 + i, f"see {w} thread", "c", 0) for i, w in enumerate(WORDS)]
    cut = [(200, "Intro here.\n\n- check the dry river\n- merge the", "n", 0), (201, "Intro here.\n\n- check the dry river\n- merge the led", "n", 0)]
    empty = [(300, None, "n", 0), (301, "", None, 0), (302, " \n", "n", 0)]
    df = spark.createDataFrame(whole + chats + cut + empty, DOCS)
    assert sorted(r["doc_id"] for r in truncation.found(df).collect()) == [200, 201]
    rates = {r["source"]: (r["texts"], r["cut"]) for r in truncation.rates(df).collect()}
    assert rates == {"n": (22, 2), "c": (20, 0)}
    assert truncation.found(df.limit(0)).count() == 0


def test_shapes_count_by_their_rate(spark):
    def intro(seed):
        return "The " + prose(seed, 30) + ".\n\n"

    asked = [(i, f"{intro(i)}Why does the cheap inbox need 27 {w} maps of the {w} harbour?\nIt does.", "n", 0) for i, w in enumerate(WORDS)]
    listed = [(100 + i, f"{intro(100 + i)}Why do we keep all the {w} maps\nWe do.", "n", 0) for i, w in enumerate(WORDS[:5])]
    chats = [(200 + i, f"nope still {w}", "c", 0) for i, w in enumerate(WORDS)]
    cut = [(300, f"{intro(300)}Why does the cheap inbox need 27 pi", "n", 0)]
    df = spark.createDataFrame(asked + listed + chats + cut, DOCS)
    assert [r["doc_id"] for r in truncation.found(df).collect()] == [300]


def test_copies_tell_what_endings_do_not(spark):
    long = prose(5, 120) + " and the end."
    words = long.split()
    # the shorter copy ends like a list item would, in the middle of a sentence
    short = " ".join(words[:100]) + "."
    df = spark.createDataFrame([(1, long, "a", 0), (2, " ".join(words[:110]), "a", 0), (3, long, "a", 0), (4, short, "a", 0)], DOCS)
    got = {r["doc_id"]: (r["cut"], r["evidence"]) for r in truncation.judge(df).collect()}
    assert got[2] == (True, "copy") and got[1] == got[3] == (False, None) and got[4][0] is False


def test_every_longer_copy_is_aligned(spark):
    """In the buckets of each short text stand longer copies with another word before its end; one of middle length aligns."""
    rows = []
    for family in range(12):
        w = prose(500 + family, 230).split()
        rows.append((100 * family, " ".join(w[:210]), "a", 0))
        rows.append((100 * family + 1, " ".join(w[:216]), "a", 0))
        rows += [(100 * family + 2 + i, " ".join([*w[:208], f"edit{i}", *w[209 : 224 + i % 6]]) + ".", "a", 0) for i in range(20)]
    got = {r["doc_id"]: r["evidence"] for r in truncation.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[100 * family] for family in range(12)] == ["copy"] * 12


def test_cut_copies_of_any_length_are_aligned(spark):
    """Copies cut to a part of their text, two in a hundred words of which were edited, end as whole list items do."""
    rows, want, r = [], {}, random.Random(9)
    for family in range(40):
        w = prose(900 + family, 200).split()
        rows.append((10 * family, " ".join(w) + ".", "a", 0))
        for at, share in enumerate([0.3, 0.5, 0.7, 0.9], 1):
            own = [f"edit{i}" if i % 50 == 20 and i < 200 * share - 10 else x for i, x in enumerate(w)]
            rows.append((10 * family + at, " ".join(own[: int(200 * share)]), "a", 0))
    got = {r["doc_id"]: r["evidence"] for r in truncation.judge(spark.createDataFrame(rows, DOCS)).collect()}
    cut = [i for i in got if i % 10]
    assert sum(got[i] == "copy" for i in cut) >= 0.98 * len(cut) and not any(got[i] for i in got if i % 10 == 0)


def test_large_buckets_lose_no_copy(spark):
    """One family with one beginning: every text meets its longer copy, also behind the probes."""
    head, rows = prose(77, 60), []
    for i in range(30):
        tail = prose(2000 + i, 40).split()
        rows.append((2 * i, f"{head} {' '.join(tail)}.", "a", 0))
        rows.append((2 * i + 1, f"{head} {' '.join(tail[:30])}", "a", 0))
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.length("text"))
    fields = "doc_id bigint, source string, length int, k1 bigint, k2 bigint, verdict string, kind string, word string, phrase string, verdict2 string, kind2 string, word2 string, own int, asked array<bigint>, answers array<bigint>, counts array<struct<kind:string,word:string,n:bigint,e:bigint>>"
    read = df.select("doc_id", "source", "text", "length").mapInArrow(truncation._reader(truncation.band_count()), fields)
    bodies = df.select("text").mapInArrow(truncation._keyed, "k1 bigint, k2 bigint, text string").select(F.struct("k1", "k2").alias("id"), "text")
    want = {tuple(r) for r in read.where("doc_id % 2 = 1").select("k1", "k2").collect()}
    for bucket, probes in ((4096, 16), (4, 1), (4, 2)):
        got = {tuple(r["id"]) for r in truncation.copies_of(read, bodies, bucket, probes).where("copy_cut").collect()}
        assert got == want


def test_probes_that_call_a_text_whole_do_not_hide_a_cut(spark):
    """In large buckets a text meets every longer copy: many in which it ends a line, one in which its sentence goes on."""
    rows, want = [], set()
    for family in range(4):
        w = prose(3000 + family, 70).split()
        own, rim = " ".join(w[:60]), " ".join([*w[:53], "(" + w[53], *w[54:60]])
        rows.append((100 * family, own, "a", 0))
        rows += [(100 * family + 1 + i, f"{own}\nThen came {prose(3100 + 100 * family + i, 4 + i)}.", "a", 0) for i in range(24)]
        # in odd families the copy's tail begins inside a word, in the others it is the same
        rows.append((100 * family + 50, f"{rim if family % 2 else own} {' '.join(w[60:])}.", "a", 0))
        want.add(100 * family)
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.length("text"))
    fields = "doc_id bigint, source string, length int, k1 bigint, k2 bigint, verdict string, kind string, word string, phrase string, verdict2 string, kind2 string, word2 string, own int, asked array<bigint>, answers array<bigint>, counts array<struct<kind:string,word:string,n:bigint,e:bigint>>"
    read = df.select("doc_id", "source", "text", "length").mapInArrow(truncation._reader(truncation.band_count()), fields).cache()
    bodies = df.select("text").mapInArrow(truncation._keyed, "k1 bigint, k2 bigint, text string").select(F.struct("k1", "k2").alias("id"), "text")
    names = {(r["k1"], r["k2"]): r["doc_id"] for r in read.select("k1", "k2", "doc_id").collect()}
    for bucket, probes in ((4096, 16), (4, 1), (4, 2)):
        got = {names[tuple(r["id"])] for r in truncation.copies_of(read, bodies, bucket, probes).where("copy_cut").collect()}
        assert got == want, (bucket, probes)


def test_tails_stand_wherever_ends_align():
    """windows brings every pair that ends_early aligns, and every place where it may say cut."""
    r, seen = random.Random(4), set()
    for _ in range(4000):
        w = [r.choice(["a", "ab", "b", "ba", "a.", "b-", "(a", "b)"]) for _ in range(r.randrange(9, 16))]
        long = "".join(x + r.choice([" ", " ", " ", "\n"]) for x in w).strip()
        body = long[: r.randrange(8, len(long))].strip()
        short = " ".join([*body.split()[:-7], *[body.split()[-7][-1], *body.split()[-6:]]]) if len(body.split()) >= 8 else body
        verdict, (end, first, sixth, last) = truncation.ends_early(short, long), truncation.tail(short)
        met, cut = False, False
        for key, before, behind, after, goes_on in truncation.windows(long) if end is not None else []:
            if key == end and before.endswith(first):
                inside, follows = behind.startswith(sixth + last), behind == sixth and (after or "").startswith(last)
                met, cut = met or inside or follows, cut or inside or (follows and (after != last or goes_on))
        assert (met or verdict == "") and (cut or verdict != "cut"), (short, long)
        seen.add(verdict)
    assert seen == {"", "cut", "whole"}


def test_bands_reach_their_recall():
    """Beginnings of which one holds 0.8 of the other's shingles meet with the chance asked for."""
    import pyarrow as pa

    r, met, tried = random.Random(3), 0, 300
    for i in range(tried):
        base = [f"w{i}x{j}" for j in range(260)]
        other = list(base)
        while len({tuple(base[k : k + 5]) for k in range(124)} & {tuple(other[k : k + 5]) for k in range(256)}) > 0.82 * 124:
            other[r.randrange(128)] = f"e{r.random()}"
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(base[:128]), " ".join(other)])], names=["text"])
        _, keys, owners = truncation.beginnings(batch, truncation.band_count())
        own, theirs = ([k for k, o in zip(keys, owners) if o == t] for t in (0, 1))
        met += bool(set(own[-1]) & {x for k in theirs for x in k})
    assert met >= 0.97 * tried


def test_whole_lists_of_ordinary_words_are_whole(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = []
        for i in range(100):
            items = [" ".join(r.choice(WORDS) for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(3, 9))]
            rows.append((i, "Things to do today are these.\n\n" + "\n".join(f"- {x}" for x in items), "n", 0))
        assert truncation.found(spark.createDataFrame(rows, DOCS)).count() == 0


def test_cut_markers_are_learnt(spark):
    cut = [(i, f"Der Weg zum alten Hafen war länger als gedacht, und nach der zweiten Brücke im Tal fand {prose(i, 6)} wied [Nachricht gekürzt, {i} Zeichen]", "m", 0) for i in range(12)]
    whole = [(100 + i, f"Der Weg zum Hafen {prose(i, 5)} war lang. [Nachtrag {i}]", "m", 0) for i in range(12)]
    short = [(200, "{ bald [Nachricht gekürzt, 7 Zeichen]", "m", 0)]
    got = {r["doc_id"]: r["cut"] for r in truncation.judge(spark.createDataFrame(cut + whole + short, DOCS)).collect()}
    assert all(got[i] for i in range(12)) and got[200] and not any(got[100 + i] for i in range(12))


def test_ends_early():
    long = "one two three four five six seven eight nine ten eleven. Twelve thirteen."
    assert truncation.ends_early("one two three four five six seven eight nine te", long) == "cut"
    assert truncation.ends_early("one two three four five six seven eight nine ten", long) == "cut"
    assert truncation.ends_early("one two three four five six seven eight nine ten eleven.", long) == "whole"
    assert truncation.ends_early("something else entirely that never stands in the other text", long) == ""

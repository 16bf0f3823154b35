"""Spelling variants, fill-in-middle and token counts against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import fim, queries, spelling, token_counts

PATH = public_tokenizers.path(queries.TOKENIZER)
CLASHES = ("word", "n", "sig", "form", "root", "held", "run", "id", "h", "lines", "n_tokens", "__text", "output")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


@pytest.fixture
def clashing(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(*table):
        frame = spark.createDataFrame(list(table), "doc_id LONG, text STRING")
        return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES])

    return build


# --- spelling variants ----------------------------------------------------------------


def _one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _words(table, every=31):
    found = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def _variants(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if _one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def _typos(rnd, word):
    k, c = rnd.randrange(len(word)), rnd.choice("abcé")
    return rnd.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def _texts():
    rnd = random.Random(5)
    base = ["spelling", "variants", "Grouping", "aaaaaaaa", "anagrams", "ÀÉÎõü÷×ß", "abababab"]
    table = [(k, " ".join(rnd.choice(base) for _ in range(60))) for k in range(30)]
    table += [(100 + k, " ".join(_typos(rnd, rnd.choice(base)) for _ in range(60))) for k in range(30)]
    # a chain of forms, each ten times as frequent as the one before
    chain = ["chainedd", "chaineds", "chainexs", "chaizexs"]
    table += [(200 + k, f"{w} " * 2 * 10**k) for k, w in enumerate(chain)]
    return table + [(None, "spelling spelling spellings Spellings"), (300, None), (301, ""), (302, "short wo-rds 1234567"), (5, "grouping " * 3), (5, "grouping " * 3)]


@pytest.mark.parametrize("hot", [spelling.HOT, 2])
def test_spelling_against_all_pairs(clashing, tmp_path, monkeypatch, hot):
    table = _texts()
    words = spelling.count_words(clashing(*table))
    assert dict(rows(words, "word", "n")) == _words(table)
    found = spelling.group_variants(words, str(tmp_path), hot=hot)
    got = rows(found, "word", "form", "root", "n", "n_near", "form_n")
    assert got == _variants(_words(table))
    by_word = {r[0]: r for r in got}
    assert by_word["chainedd"][1:3] == ("chaineds", "chaizexs")


def test_spelling_without_the_rule_and_of_nothing(clashing, tmp_path):
    table = _texts()
    found = spelling.spelling_variants(clashing(*table), every=0, root=str(tmp_path / "a"))
    assert rows(found, "word", "form", "root", "n", "n_near", "form_n") == _variants(_words(table, 0))
    assert spelling.spelling_variants(clashing(*table).limit(0), root=str(tmp_path / "b")).count() == 0


def test_words_one_edit_apart_share_a_signature():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(7, 16))) for _ in range(400)]
    typos = [_typos(rnd, w) for w in words]
    table = spelling.signature_table(pa.array(words + typos))
    assert all(set(table[k]) & set(table[k + 400]) for k in range(400))
    assert spelling.signature_table(pa.array(["", "a"])).shape == (2, table.shape[1])


def test_equal_letters_alone_make_no_candidates():
    table = spelling.signature_table(pa.array(["abcdefgh", "hgfedcba", "efghabcd"]))
    assert len(set(table.ravel().tolist())) == table.size


def test_long_texts_and_hot_words(clashing):
    table = [(1, "frequent " * 200_000 + "x" * 100_000), (2, "frequent " * 3)]
    assert dict(rows(spelling.count_words(clashing(*table), every=0), "word", "n")) == {"frequent": 200_003}


def test_near_pairs_are_an_equi_join(spark):
    words = spark.createDataFrame([("spelling", 3), ("spellings", 2)], "word STRING, n LONG")
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# --- fill in the middle -----------------------------------------------------------------


def _fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100)])
def test_fim_against_plain_slices(clashing, rate, spm):
    rnd = random.Random(3)
    table = [(k, "".join(rnd.choice("ab\n\n é😀<P") for _ in range(rnd.randrange(60)))) for k in range(300)]
    table += [(400, None), (401, ""), (402, "\n"), (403, "\n\n\n"), (404, "no line end"), (405, "a <P> b"), (406, "<M>"), (407, "<S>\nx"),
              (None, "a\nb\nc"), (408, "<\n<S\nP>\nM>"), (409, "line é\n" * 30_000), (409, "line é\n" * 30_000), (410, "x" * 300_000)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text in table:
        *head, output = _fim(doc_id, text, rate, spm)
        want.append((doc_id, *head, sha(output), sha(text or ""), output))
    found = fim.transform(clashing(*table), rate=rate, spm=spm)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
    assert rows(found, *names) == sorted(want, key=repr)
    assert fim.transform(clashing(*table).limit(0)).count() == 0


def test_fim_keeps_columns_of_any_name(clashing):
    packed = clashing((1, "a\nb")).select(F.struct("*").alias("__doc"), "doc_id", "text")
    assert fim.transform(packed, keep=("__doc",)).select("__doc.*").columns == ["doc_id", "text", *CLASHES]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 1000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(0, 50, n)
    lines = fim.SkipList(widths)
    assert [lines.before(k) for k in range(n + 1)] == [0, *np.cumsum(widths).tolist()]


def test_skip_list_follows_few_links():
    lines = fim.SkipList(np.ones(fim.FAN**6, np.int64))
    assert len(lines.lanes) == 6 and len(lines.lanes[-1][0]) == fim.FAN


# --- token counts -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _count(library, text):
    return len(library.encode(text or "", add_special_tokens=False))


ODD = ["It's we'll ' s", "<|endoftext|>a<|startoftext|> <|endof", "é ́x 1̧́ 2", "中文，字 12中3", "각 ᅡ", "\x1c\x85　 ​ a", "don't1't2'll 3're", "ﬁ Å ΑΣ Σ", "\r\n\t\x0b\x0c", "1 2  3\n\n4", "😀😀 a😀1"]


def test_chunked_counts_equal_the_library(library):
    rnd = random.Random(9)
    tool = token_counts.Counter(PATH)
    for trial in range(150):
        text = "".join(rnd.choice(ODD + ["word", "abc", " ", "\n", "'s", "x" * 40]) for _ in range(rnd.randrange(1, 120)))
        chunk, overlap = rnd.choice([(16, 4), (50, 8), (200, 30), (64, 1)])
        assert tool.long(text, chunk, overlap) == _count(library, text), (trial, chunk, overlap)


@pytest.mark.parametrize("text", ["a" * 3000, "中" * 2000, "a" * 900 + " " + "!" * 1500 + "1", "é" * 1000 + "\n" + "b" * 10, "'" * 999 + "s 1"])
def test_overlaps_widen_until_a_stable_place_is_found(library, text):
    assert token_counts.Counter(PATH).long(text, 100, 10) == _count(library, text)


def test_no_call_of_the_library_takes_a_huge_document(monkeypatch):
    tool, seen = token_counts.Counter(PATH), []
    inner = tool.spans
    monkeypatch.setattr(tool, "spans", lambda text: seen.append(len(text)) or inner(text))
    text = "some words 12 and more, " * 20_000
    assert tool.long(text) == 20_000 * 7 and max(seen) <= token_counts.CHUNK + token_counts.OVERLAP
    assert sum(seen) < 1.05 * len(text)


def test_a_file_without_the_proof_is_encoded_whole(tmp_path):
    other = re.sub(r"\[\\\\p\{N\}\]", r"[\\\\p{N}]+", open(PATH, encoding="utf-8").read())
    (tmp_path / "other.json").write_text(other, encoding="utf-8")
    tool = token_counts.Counter(str(tmp_path / "other.json"))
    assert not tool.proven and token_counts.Counter(PATH).proven
    text = "12345 " * 50
    assert tool.long(text, 20, 5) == _count(Tokenizer.from_file(str(tmp_path / "other.json")), text)


def test_token_counts_query_columns(clashing, library):
    table = [(k, t) for k, t in enumerate(ODD)]
    table += [(50, None), (51, ""), (None, "null id"), (52, "long text 7 " * 12_000), (52, "long text 7 " * 12_000), (53, "x" * 80_000), (54, "word " * 2048), (55, "word " * 2049)]
    want = [(i, len((t or "").encode()), _count(library, t), _count(library, t) > 2048) for i, t in table]
    found = token_counts.token_counts(clashing(*table), PATH)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(clashing(*table).limit(0), PATH).count() == 0


def test_cache_stays_bounded(library):
    tool = token_counts.Counter(PATH, cache_pieces=50)
    for k in range(10):
        texts = [f"w{n * 7919} and {'y' * 70}{n}" for n in range(k * 20, k * 20 + 20)]
        assert tool.short(texts) == [_count(library, t) for t in texts]
        assert len(tool.known) <= 50 and all(len(p) <= token_counts.LONGEST_CACHED for p in tool.known)

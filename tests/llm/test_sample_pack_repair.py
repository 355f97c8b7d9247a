"""Importance resampling, packing and structure repair against brute force on small tables of odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberscope.llm import importance, packing, structure_repair
from emberscope.llm.batch_encoder import BatchEncoder, with_end
from emberscope.llm.queries import LLM_QUERIES

DOC = "doc_id long, text string, rank long, weight string, bin int, row string, n string, task int, at int, members string"
SYLLABLES = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "é", "É", "é", "'s", "'LL", ".", ",", "..", "3", "45", " ", "　", "İ", "Σ", "ß",
             "日", "<|endoftext|>", "<|startoftext|>", "\x00", "-", "word", "The", "\r\n", "\x0b", "\x85", "ﬁ", "ª", "́"]


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 19, 20, 21, 60, 200, 900)))) for _ in range(60)]
    texts += [None, "", " ", "x" * 5000, "One TWO! " * 20, "One TWO! " * 20, "日本 é " * 300, "a\x00b " * 30]
    rows = [(i, t, 1, "w", 2, "r", "n", 3, 4, "m") for i, t in enumerate(texts)]
    hot = [(None, "same text again " * 12, None, None, None, None, None, None, None, None)] * 30
    return rows + hot + [rows[5], rows[5], (7, "another text of seven " * 10, 1, "w", 2, "r", "n", 3, 4, "m")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "abc one two same"), (2, None), (3, "Two Text again")], "item_id long, text string")


FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = FEATURE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [w.encode() for w in words] + [f"{a} {b}".encode() for a, b in zip(words, words[1:])]


def plain_resample(rows, target):
    s, t = Counter(), Counter()
    for row in rows:
        s.update(zlib.crc32(f) % 10000 for f in features(row[1])[1])
    for text in target:
        t.update(zlib.crc32(f) % 10000 for f in features(text)[1])
    of, to, out = sum(s.values()), sum(t.values()), []
    for row in rows:
        words, own = features(row[1])
        gain = [math.floor(1000 * math.log((t[b] + 1) * (of + 10000) / ((s[b] + 1) * (to + 10000)))) for b in (zlib.crc32(f) % 10000 for f in own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        out.append((row[0], len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    chosen = able[: 25 * len(able) // 100]
    return Counter(out), [(r[4], r[0]) for r in chosen]


def test_resample(docs, bench):
    expected, chosen = plain_resample(corpus(), ["abc one two same", None, "Two Text again"])
    got = importance.resample(docs, bench, carry=["text", "rank"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == expected
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(chosen) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == chosen
    assert Counter(r.row.text for r in got) == Counter(r[1] for r in corpus())


def test_resample_without_rows(spark, docs, bench):
    empty = docs.limit(0)
    assert importance.resample(empty, bench).count() == 0
    expected, chosen = plain_resample(corpus(), [])
    got = importance.resample(docs, bench.limit(0)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == expected
    assert sum(r["rank"] is not None for r in got) == len(chosen)


def test_crc_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    starts, sizes = rng.integers(0, 2000, 400), rng.integers(0, 600, 400)
    expected = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert importance.crc32_spans(data, starts, sizes).tolist() == expected
    texts = [r[1] for r in corpus()]
    for words in (1, 2, 7, 1 << 20):  # pairs across slices and texts
        monkeypatch.setattr(importance, "SLICE_WORDS", words)
        batch = importance.Words(pa.array([t.encode() if t else None for t in texts], pa.binary()))
        single, double = [], []
        for _, _, one, two, inside in importance.slices(batch, 10000):
            single += one.tolist()
            double += two[inside].tolist()
        lists = [features(t) for t in texts]
        assert single == [zlib.crc32(f) % 10000 for w, own in lists for f in own[: len(w)]]
        assert double == [zlib.crc32(f) % 10000 for w, own in lists for f in own[len(w) :]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batch_encoder(name):
    rng = random.Random(8)
    texts = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [r[1] for r in corpus()]
    code = BatchEncoder(public_tokenizers.path(name), stored_ids=2000)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        ids, counts = with_end(*code.encode(pa.array(part, pa.string())), 5)
        assert ids.tolist() == [i for t in part for i in [*plain.encode(t or "", add_special_tokens=False).ids, 5]]
        assert counts.sum() == len(ids)
    ids, counts = code.encode(pa.array([b"ab \xff c", None], pa.binary()))
    assert counts.tolist() == [len(plain.encode("ab � c", add_special_tokens=False).ids), 0]


def test_best_fit():
    rng = random.Random(1)
    for capacity in (7, 50, 2048):
        sizes = [rng.randint(1, capacity) for _ in range(300)]
        bins = packing.best_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(300))
        free = []  # plain best fit, longest first
        for n in sorted(sizes, reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(capacity - n)
        assert sorted(capacity - sum(sizes[i] for i in b) for b in bins) == sorted(free)
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


def check_packed(packed, capacity, tokenizer):
    plain = Tokenizer.from_file(tokenizer)
    got = packing.placements(packed).collect()
    whole = Counter()
    for doc_id, text, *_ in corpus():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a : a + capacity]
            whole[doc_id, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == whole
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    texts = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    for number, parts in by_sequence.items():
        at = 0
        for offset, length, crc in sorted(parts):
            assert offset == at and zlib.crc32(texts[number][1][4 * at : 4 * (at + length)]) == crc
            at += length
        assert at == texts[number][0] <= capacity and len(texts[number][1]) == 4 * at
    assert len(texts) == len(by_sequence)
    return len(by_sequence), sum(r.length for r in got)


def test_pack(docs):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    n, total = check_packed(packing.pack(docs, tokenizer, with_ids=True), 2048, tokenizer)
    assert n <= -(-total // 2048) + 1
    n, total = check_packed(packing.pack(docs.repartition(6), tokenizer, capacity=100, with_ids=True, group_items=10), 100, tokenizer)
    assert n <= 1.1 * total / 100 + 1
    assert packing.placements(packing.pack(docs.limit(0), tokenizer)).count() == 0


LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(word):
    """(cost, audit, kept roles) by trying all edits that cost no more than deleting all rows."""
    best = []

    def go(i, cost, audit, roles, out):
        if cost > 4 * len(word):
            return
        if i == len(word) and LEGAL.fullmatch(roles):
            best.append((cost, audit, out))
        for role in "ua":
            if len(roles) < len(word) + 3:
                go(i, cost + 3, audit + "I", roles + role, [*out, (None, role)])
        if i == len(word):
            return
        go(i + 1, cost + 4, audit + "D", roles, out)
        if word[i] != "x":
            late = 3 * word[i].isupper()
            go(i + 1, cost + late, audit + "K", roles + word[i].lower(), [*out, (i, word[i].lower())])
            for role in "ua":
                go(i + 1, cost + 3 + late, audit + "R", roles + role, [*out, (i, role)])

    go(0, 0, "", "", [])
    return min(best, key=lambda b: b[:2])


def solve_words(words):
    tails = sorted("$" + w[::-1] for w in words)
    out = {}
    for k in range(0, len(tails), 50):
        batches = structure_repair.solve([pa.RecordBatch.from_pydict({"tail": tails[k : k + 50]})])
        for batch in batches:
            for row in batch.to_pylist():
                out[row["solved_tail"][:0:-1]] = next((b["cost"], b["edits"]) for b in row["best"] if b["state"] == 0)
    return out


def test_edits_are_cheapest():
    words = ["".join(w) for n in range(1, 4) for w in itertools.product("suaoSUAOx", repeat=n)]
    got = solve_words(words)
    rng = random.Random(9)
    longer = ["".join(rng.choice("suaoUAx") for _ in range(4)) for _ in range(40)]
    got |= solve_words(longer)
    for word in words + longer:
        assert got[word] == cheapest(word)[:2], word


def test_suffixes_are_solved_once(monkeypatch):
    made = []
    node = structure_repair.node
    monkeypatch.setattr(structure_repair, "node", lambda letter, rest: made.append(letter) or node(letter, rest))
    words = ["".join(w) for w in itertools.product("suax", repeat=4)]
    tails = sorted("$" + w[::-1] for w in words)
    list(structure_repair.solve([pa.RecordBatch.from_pydict({"tail": tails[:100]}), pa.RecordBatch.from_pydict({"tail": tails[100:]})]))
    assert len(made) == len({w[k:] for w in words for k in range(4)})


def plain_repair(rows, damaged):
    """Straight from the rules, one conversation at a time."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 99
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, word, faults = set(), "", Counter()
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not marks:
                fault, letter = "blank", "x"
            elif (role, text) in seen:
                fault, letter = "duplicate", "x"
            elif marks[-1] not in ".!?":
                fault, letter = "truncated", letter.upper()
            else:
                fault = ""
            faults[fault] += 1
            seen.add((role, text))
            word += letter
        cost, audit, kept = (0, "", []) if not word else cheapest(word)
        lines = [f"{own[i][1] if i is not None and own[i][1][:1] == r else {'u': 'user', 'a': 'assistant'}[r]}:{own[i][2] if i is not None else ''}" for i, r in kept]
        turns = {t for t, _, _ in own if t is not None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


TURN = "conv_id long, turn long, role string, text string, at long, n string, digest string, kind int, word string"


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " \t", "", None, "a b.\n ", "é!", "no. "]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3 - 1, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.", 1, "n", "d", 5, "w"))
    return rows + [(151, 0, "user", None, 1, None, None, None, None), (152, 3, "user", "Hi.", 1, None, None, None, None), (152, 3, "user", "Hi.", 2, None, None, None, None)]


def collected(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("damaged", [True, False])
def test_repair(spark, damaged):
    rows = conversations(5)
    frame = spark.createDataFrame(rows, TURN).repartition(3)
    assert collected(structure_repair.repair(frame, damaged)) == plain_repair(rows, damaged)
    assert structure_repair.repair(frame.limit(0), damaged).count() == 0


def test_blocks_of_long_conversations(spark):
    """Cut into tiny blocks and whole, conversations get the same edits; so do hundreds of equal rows."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", f"t {t}.", f"t {t}", ""]), 1, "n", "d", 5, "w") for c in range(12) for t in range(rng.choice((5, 30, 90)))]
    rows += [(99, 1, "user", "Hot.", 1, "n", "d", 5, "w")] * 700 + [(99, 2, "assistant", "Cold.", 1, "n", "d", 5, "w")]
    frame = spark.createDataFrame(rows, TURN).repartition(3)
    whole = collected(structure_repair.repair(frame))
    blocks = structure_repair.solved_blocks(structure_repair.whole(frame), 3).collect()
    assert len(blocks) > len(rows) / 4 and max(len(b.word) for b in blocks) <= 3
    assert collected(structure_repair.repair(frame, block_rows=3)) == whole
    assert whole[99][2] == 699 and whole[99][6] == "K" + "D" * 699 + "K"
    short = [r for r in rows if r[0] < 12 and r[1] < 4]
    assert collected(structure_repair.repair(spark.createDataFrame(short, TURN))) == plain_repair(short, False)


def test_query_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(LLM_QUERIES["op13_suffix_automaton_repair"](spark, sf_dir))
    assert got.keys() == {r[0] for r in rows}
    short = {c for c, n in Counter(r[0] for r in rows).items() if n <= 4}
    expected = plain_repair([r for r in rows if r[0] in short], True)
    assert {c: got[c] for c in expected} == expected

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected, chosen = plain_resample(docs, bench)
    drawn = LLM_QUERIES["op11_crc_importance_resampling"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in drawn) == Counter({(k[0], *k[2:]): n for k, n in expected.items()})
    assert [r.doc_id for r in sorted((r for r in drawn if r["rank"]), key=lambda r: r["rank"])] == [d for _, d in chosen]

    packed = LLM_QUERIES["op12_residual_best_fit_packing"](spark, sf_dir).collect()
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1
    assert {r.doc_id for r in packed} == {d for d, _ in docs}

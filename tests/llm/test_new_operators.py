"""Turn repair, Simple-8b files and the filter audit against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pytest

from vitrine.llm import filteraudit, simple8b, turnrepair
from vitrine.session import scratch_path, ship_package

SPACE = r"[^\x20\x09-\x0D]"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ---------------------------------------------------------------- turn repair
def cheapest(rows):
    """(cost, edits) by all ways from the end on: rows are (initial, goes, cut)."""
    @lru_cache(None)
    def best(i, state, inserted):
        out, to = [], turnrepair.NEXT[state]
        if i == len(rows):
            if state in (0, 3):
                out.append((0, ""))
        else:
            initial, goes, cut = rows[i]
            ways = [(3, "D", state)]
            if not goes:
                ways.append((2 + cut, "R", to))
                if initial == "s" and state == 0:
                    ways.append((cut, "K", 1))
                if initial == {2: "u", 3: "a"}[to]:
                    ways.append((cut, "K", to))
            for c, e, q in ways:
                cost, edits = best(i + 1, q, 0)
                out.append((cost + c, e + edits))
        if inserted < 3:
            cost, edits = best(i, to, inserted + 1)
            out.append((cost + 2, "I" + edits))
        return min(out) if out else (10 ** 9, "~")
    return best(0, 0, 0)


def test_search_equals_all_ways():
    random.seed(5)
    for _ in range(3000):
        alphabet = random.choice(["sua", "ua", "sua x", "aaau", "s", "su"])
        goes, cut = random.choice([0, .2, .9]), random.choice([0, .3, .9])
        rows = []
        for _ in range(random.randint(0, 12)):
            g = random.random() < goes
            rows.append((random.choice(alphabet), g, not g and random.random() < cut))
        search, edits = turnrepair.Survivors(), []
        for r in rows:
            edits += search.add(*r)
        cost, rest, closing = search.finish()
        assert (cost, "".join(edits + rest) + "I" * closing) == cheapest(tuple(rows))


@pytest.mark.parametrize("alphabet", ["ua", "a", "s", "x", "sua"])
def test_search_holds_few_rows(alphabet):
    random.seed(6)
    search, open_rows, most = turnrepair.Survivors(), 0, 0
    for i in range(20_000):
        initial = alphabet[i % len(alphabet)] if random.random() < .9 else random.choice("sua")
        open_rows += 1 - len(search.add(initial, random.random() < .1, random.random() < .1))
        most = max(most, open_rows)
    assert most < 1000


def expected_report(rows):
    """The report by brute force; rows are (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in kept if t is not None}
        seen, faults, facts = set(), [0, 0, 0], []
        for _, role, text in kept:
            fault = None
            if not re.search(SPACE, text):
                fault = 0
            elif (role, text) in seen:
                fault = 1
            elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
                fault = 2
            if fault is not None:
                faults[fault] += 1
            seen.add((role, text))
            facts.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest(tuple(facts))
        lines, i, state = [], 0, 0
        for e in audit:
            if e != "I":
                _, role, text = kept[i]
                i += 1
            if e == "D":
                continue
            state = 1 if e == "K" and state == 0 and role[:1] == "s" else turnrepair.NEXT[state]
            lines.append(f"{role}:{text}" if e == "K" else
                         f"{turnrepair.ROLE[state]}:{text if e == 'R' else ''}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    random.seed(7)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(random.randint(1, 9)):
            rows.append((conv, random.choice([turn, turn, turn, None, 2 * turn]),
                         random.choice(["user", "assistant", "system", "", None, "User", "tool"]),
                         random.choice(["Yes.", "No!", "Why", "", None, " \n", "A. b\t", "é?"])))
    return rows + rows[:20]


def test_report_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, present int, _conv string")
    got = {r[0]: tuple(r)[1:] for r in turnrepair.report(turnrepair.damage(df), present="present").collect()}
    assert got == expected_report(rows)


def test_repaired_turns(spark):
    text = "word " * 20_000
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", text), (1, 2, "user", text), (1, 3, "assistant", "End."),
            (2, 0, "user", ""), (3, None, None, None)]
    got = sorted(map(tuple, turnrepair.repair(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "Hi."), (1, 2, "user", text), (1, 3, "assistant", "End.")]


def test_turns_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turnrepair.report(turnrepair.damage(empty), present="present").collect() == []
    assert turnrepair.repair(empty).collect() == []


# ------------------------------------------------------------------- Simple-8b
def test_words_hold_all_ids():
    rng = np.random.default_rng(0)
    for t in range(200):
        n = int(rng.integers(0, 700))
        width = rng.integers(0, 64 if t % 2 else 17, n)
        ids = (rng.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(3)) >> (np.uint64(63) - width.astype(np.uint64))
        if t % 5 == 0:
            ids[rng.random(n) < .9] = 0
        words, escapes = simple8b.encode(ids)
        assert (simple8b.decode(words, escapes, n) == ids).all()
        assert len(escapes) == (ids >= 1 << 60).sum()
        parts = np.split(ids, np.sort(rng.integers(0, n + 1, 6)))
        own = next(simple8b.segments(simple8b.segment_bytes(
            3, 1, 5, 9, [*range(6), None], [len(x) for x in parts], ids) + b"\n"))
        assert (own.shard, own.number, own.docs_before, own.ids_before) == (3, 1, 5, 9)
        for k, part in enumerate(parts):
            assert (own.doc_ids(k) == part).all()


def test_words_are_full():
    """Greedy words: the next id never fits into the word before it."""
    ids = (np.random.default_rng(1).zipf(1.3, 20_000) % 49_408).astype(np.uint64)
    words, _ = simple8b.encode(ids)
    held = simple8b.held_ids(words)
    assert held.sum() >= len(ids) > held[:-1].sum()
    at = np.cumsum(held) - held
    for i, (start, n) in enumerate(zip(at.tolist(), held.tolist(), strict=True)):
        more = [s for s in range(1, 16) if simple8b.COUNT[s] > n and start + simple8b.COUNT[s] <= len(ids)]
        for s in more:
            assert int(ids[start:start + simple8b.COUNT[s]].max()).bit_length() > simple8b.WIDTH[s], i


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_files_read_back(spark):
    path, own = tokenizer()
    rng = random.Random(2)
    texts = [None, "", "  \n", "Hello, World!", "é" * 300, "<|endoftext|> x", "long " * 50_000, "1234 #$%", "日本語 text"]
    texts += [" ".join(rng.choice(["alpha", "Beta.", "gamma,", "δ", "don't"]) for _ in range(rng.randint(1, 80)))
              for _ in range(120)]
    rows = [(i * 7 % 131, t, "x", 0) for i, t in enumerate(texts)] + [(5, "again", "y", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, salt long").repartition(4)
    folder = scratch_path(spark, "ids")
    simple8b.write(df, path, folder, segment_ids=200)
    got = simple8b.digests(spark, folder).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = {}
    for doc, text, _, _ in rows:
        ids.setdefault(doc, []).append([*own.encode(text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    crc = sorted((d, len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, many in ids.items() for i in many)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in simple8b.read(spark, folder).collect()}
    assert {(r["doc_id"], r["start"]) for r in got} == set(whole)
    assert all(whole[r["doc_id"], r["start"]] in ids[r["doc_id"]] for r in got)


def test_files_of_null_ids_and_of_nothing(spark):
    path, _ = tokenizer()
    df = spark.createDataFrame([(None, "a"), (None, None), (3, "b")], "doc_id long, text string")
    got = simple8b.round_trip(df, path, scratch_path(spark, "ids")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 3]
    assert got[-1]["start"] == 3
    assert simple8b.round_trip(df.limit(0), path, scratch_path(spark, "ids")).collect() == []


# ---------------------------------------------------------------- filter audit
def expected_audit(docs, labels):
    """Every document through every order."""
    quality, toxic = {}, {}
    for i, q, t in labels:
        if i is None:
            continue
        quality[i], toxic[i] = max(quality.get(i, 0), q or 0), max(toxic.get(i, 0), t or 0)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(SPACE + "+", t)
        fails = {c for c, f in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t),
            i is not None and least[t] < i), strict=True) if f}
        rows.append((part or "", fails, quality.get(i) == 1, toxic.get(i) == 1))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for f in "ABCDE":
            total = sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == f)
            for k, v in out.items():
                if k[0] == part and k[1][k[2] - 1] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t", "plain words here", "SHOUTING A LOT", "a " * 300, "with $ and #",
             " ".join(f"w{i}" for i in range(250)), "É" * 50, "x" * 100_000, " ".join(f"W{i}|" for i in range(250))]
    docs = [(rng.randint(0, 60), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(150)]
    docs += [(None, texts[3], "a"), (None, None, None)] + docs[:10]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "q") for r in docs],
                              "doc_id long, text string, source string, mask int, quality string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filteraudit.audit(d, lab).collect()}
    assert got == expected_audit(docs, labels)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(d, lab).collect() == []
    assert filteraudit.audit(spark.createDataFrame([(1, "t", "s")], d.schema), lab).count() == 600

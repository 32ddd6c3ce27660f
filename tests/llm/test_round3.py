"""Line dedup, Merkle manifest and conversation repair against brute force, edge cases included."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import line_dedup, merkle, repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, n long, digest string, h string, _at long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def frame(spark, rows):
    """Rows (doc_id, text, source), with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "t", 1, 2, "d", "h", 3) for i, t, s in rows], SCHEMA).repartition(3)


TEXTS = [None, "", "\n\n", "Shared  \nown 1\n\tSHARED\n", "own 2", "shared\x0c\nrare\nrare", "x" * 200_000 + "\nshared", "é shared\nÉ shared", "\n".join(f"l{i}" for i in range(20_000)) + "\nshared", "rare"]


@pytest.mark.parametrize("common", [200_000, 1])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_line_dedup(spark, common, least):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "a"), (None, "rare\nown 9", None), (None, "own 2", None)]
    docs = frame(spark, rows)
    key = lambda s: lower(s.strip(SPACE))
    held = {}
    for _, t, _ in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    want = []
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        kept = [s for s in parts if not key(s) or held[key(s)] < least]
        want.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    out = line_dedup.drop_shared_lines(docs, least, common=common)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_line_dedup_empty_and_blank(spark):
    docs = frame(spark, [(i, " \n\n", "a") for i in range(30)])
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0
    assert {(r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_shared_lines(docs).collect()} == {(3, 0, " \n\n")}
    same = frame(spark, [(7, "One\ntwo", "a")] * 12)  # equal rows count each and all lose their lines
    assert [(r.n_dropped, r.kept_text) for r in line_dedup.drop_shared_lines(same).collect()] == [(2, "")] * 12


def test_line_dedup_is_native(spark, monkeypatch):
    plans = []
    keep = line_dedup.materialize

    def spy(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(line_dedup, "materialize", spy)
    out = line_dedup.drop_shared_lines(frame(spark, [(1, "a\nb", "x")]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any(re.search("Python|Arrow|Pandas", p) for p in plans)


def brute_tree(leaves, fan):
    """Root, and per leaf its path of (before, after)."""
    paths, members, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        nodes, groups = [], []
        for at in range(0, len(level), fan):
            run = level[at:at + fan]
            for j in range(len(run)):
                for leaf in members[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            nodes.append(sha(*run))
            groups.append([x for m in members[at:at + fan] for x in m])
        level, members = nodes, groups
    return level[0], paths


def brute_manifest(rows, fan):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s: sha(*map(field, (i, s, "en", None, t)))
    out, trees = [], {}
    for i, t, s in rows:
        trees.setdefault(s, []).append((i is not None, i or 0, leaf(i, t, s), i, t, s))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: brute_tree([x[2] for x in sorted(trees[s])], fan) for s in order}
    root, above = brute_tree([built[s][0] for s in order], fan)
    for at, s in enumerate(order):
        for (_, _, h, i, t, _), path in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1], strict=True):
            path = path + above[at]
            node = leaf(i, lower(t) if t is not None else None, s) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else h
            for before, after in path:
                node = sha(before, node, after)
            out.append((i, h, built[s][0], root, sha(*[b + a for b, a in path]), node, node == root))
    return out


def test_merkle_manifest(spark):
    rows = [(i, f"Text {i} é", f"s{i % 3}" if i % 2 else "hot") for i in range(700)]
    rows += [(5, "Again", "s2"), (5, "Again", "s2"), (5, None, "s2"), (None, "no key", "s2"), (3000, "alone", "single"), (3001, "", None), (3002, None, None), (3003, "Z" * 100_000, "")]
    docs = frame(spark, rows)
    got = [tuple(r) for r in merkle.audit_tampering(docs).collect()]
    want = brute_manifest(rows, 16)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}
    assert merkle.audit_tampering(docs.limit(0)).count() == 0
    one = merkle.audit_tampering(frame(spark, [(1, "x", None)])).first()
    assert one.leaf == one.root == one.folded_root and one.verified and one.proof_sha256 == sha()


def test_merkle_narrow_and_many_blocks(spark):
    rows = [(i, str(i), "a") for i in range(3000)]
    out = merkle.merkle_manifest(frame(spark, rows), fan=2)  # six blocks on the first level
    root, paths = brute_tree([sha(f"{len(str(i))}:{i}", "1:a", "2:en", "-", f"{len(str(i))}:{i}") for i in range(3000)], 2)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].root == root and [(p.left, p.right) for p in got[i].proof] == paths[i] for i in range(3000))


# ---- conversation repair


def best_edits(rows):
    """Backward recursion over (row, state): (cost, edits, output), least cost first, then ASCII."""
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    nxt = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    @functools.cache
    def go(i, state, inserts=0):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, must, extra = rows[i]
            c, e, o = go(i + 1, state)
            found.append((c + 4, "D" + e, o))
            if not must:
                if state in kept.get(role[:1], {}):
                    c, e, o = go(i + 1, kept[role[:1]][state])
                    found.append((c + extra, "K" + e, ((role, text), *o)))
                c, e, o = go(i + 1, nxt[state][0])
                found.append((c + 3 + extra, "R" + e, ((nxt[state][1], text), *o)))
        if inserts < 3:
            c, e, o = go(i, nxt[state][0], inserts + 1)
            found.append((c + 3, "I" + e, ((nxt[state][1], ""), *o)))
        return min(found, default=(10**9, "", ()))

    return go(0, 0)


def test_search_matches_recursion():
    rng = random.Random(5)
    for n in [*range(8)] * 60 + [40] * 30:
        rows = [(rng.choice(["user", "assistant", "system", "tool", " ", ""]), f"t{i}", rng.random() < .2, 3 * (rng.random() < .4)) for i in range(n)]
        got = []
        s = repair.Search(lambda edit, row: got.append((edit, row)))
        for role, text, must, extra in rows:
            s.add(role, text, must, extra > 0)
        s.end()
        cost, edits, out = best_edits(tuple(rows))
        assert (s.cost, "".join(e for e, _ in got), tuple(r for _, r in got if r)) == (cost, edits, out), rows


def unresolved(search):
    nodes, todo = 0, [search.root]
    while todo:
        node = todo.pop()
        nodes += 1
        todo.extend(node.after)
    return nodes


@pytest.mark.parametrize("pattern", ["ua", "u", "a", "uua", "usa", "random"])
def test_search_memory(pattern):
    rng, most, edits = random.Random(3), 0, []
    s = repair.Search(lambda edit, row: edits.append(edit))
    for i in range(20_000):
        role = rng.choice("usa") if pattern == "random" else pattern[i % len(pattern)]
        s.add({"u": "user", "s": "system", "a": "assistant"}[role], "x", rng.random() < .05, rng.random() < .1)
        if i % 50 == 0:
            most = max(most, unresolved(s))
    s.end()
    assert most < 400, most
    assert len(edits) >= 20_000


def test_search_open_rows_take_linear_time():
    edits = []
    s = repair.Search(lambda edit, row: edits.append(edit))
    for _ in range(100_000):
        s.add("system", "x.", False, False)
    s.add("user", "x.", False, False)
    s.end()
    assert len(edits) >= 100_001 and edits[0] == "K"


def brute_conversations(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " ", turn))
    out = []
    for conv, given in convs.items():
        after = []
        for _, _, role, text, turn in sorted(given):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
                after += [row] * (1 + (kind == 3))
        seen, faults = set(), []
        for _, role, text in after:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        cost, edits, result = best_edits(tuple((r, t, f in ("blank", "duplicate"), 3 * (f == "truncated")) for (_, r, t), f in zip(after, faults, strict=True)))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:], strict=False)]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, sha("\n".join(f"{r}:{t}" for r, t in result)), result))
    return out


def test_repair_of_damaged_conversations(spark):
    rng, rows = random.Random(11), []
    texts = ["Well then.", "No?", "cut off", "", "  \n", None, "é!", "x" * 50_000 + ".", "Same.", "a\nb"]
    for conv in [None, *range(150)]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), rng.choice(texts)))
    rows += [(500, 2**40, "user", "Hi."), (501, None, None, None), *[(502, 1, "user", "Same.")] * 5]
    table = spark.createDataFrame([(*r, True, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, gone boolean, fault string, place long").repartition(3)
    want = brute_conversations(rows)
    got = [tuple(r) for r in repair.repair_summary(repair.damage(table)).collect()]
    assert sorted(got, key=str) == sorted([w[:-1] for w in want], key=str)
    out = repair.repaired(repair.damage(table)).collect()
    by_conv = {}
    for r in sorted(out, key=lambda r: r.turn):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text))
    assert by_conv == {w[0]: list(w[-1]) for w in want if w[-1]}
    assert repair.repair_summary(repair.damage(table.limit(0))).count() == 0 and repair.repaired(repair.damage(table.limit(0))).count() == 0
    again = repair.repair_summary(repair.as_rows(repair.repaired(repair.as_rows(table.where("conv_id < 100")))))
    assert again.where("illegal > 0 and not audit rlike 'I|R|D'").count() == 0


def test_repair_long_conversation(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = repair.repair_summary(repair.as_rows(rows)).first()
    assert got.truncated == got.duplicate == got.blank == got.gaps == 0 and len(got.audit) >= 60_000
    assert repair.repaired(repair.as_rows(rows)).where("role = 'user'").count() * 2 == repair.repaired(repair.as_rows(rows)).count()

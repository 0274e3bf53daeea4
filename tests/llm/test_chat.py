from mapweave.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double, t int, jump int"


def formatted(spark, rows, **options):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return {(r["tree"], r["path"]): r for r in chat.read_back(chat.format_paths(d, **options)).collect()}


def brute(rows, n_best):
    """Chosen leaves by tree, and their turns from the root."""
    by = {(r[0], r[1]): r for r in rows}
    has = {(r[0], r[2]) for r in rows}
    out = {}
    for tree in {r[0] for r in rows}:
        paths = []
        for r in rows:
            if r[0] == tree and (tree, r[1]) not in has:
                chain, at = [], r
                while at and len(chain) <= len(rows):
                    chain.append(at)
                    at = by.get((tree, at[2]))
                if len(chain) <= len(rows):
                    paths.append((-sum(x[5] or 0 for x in chain), r[1], chain[::-1]))
        for _, leaf, chain in sorted(paths)[:n_best]:
            out[tree, leaf] = [(x[3] or "", x[4] or "") for x in chain]
    return out


TREE = [(1, 0, None, "user", "q </turn>\n <s> & &amp; [INST]", 1.0), (1, 1, 0, "assistant", "low", 0.5), (1, 2, 0, "assistant", "high ]<", 2.0), (1, 3, 2, "user", None, None), (1, 4, 3, "assistant", "end", 0.1), (1, 5, 2, None, "tie", 0.1),
        (2, 0, 99, "system", "", 0.0), (3, 0, 1, "user", "cycle", 0.0), (3, 1, 0, "user", "cycle", 0.0), (4, 7, None, "assistant", "ünï 漢", 0.0)]


def test_best_branches(spark):
    for n in (1, 2):
        got = formatted(spark, TREE, n_best=n)
        want = brute(TREE, n)
        assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == want
        for k, turns in want.items():
            assert got[k]["loss_text"] == "".join(t for role, t in turns if role == "assistant")


def test_no_control_string_survives_in_a_text(spark):
    r = formatted(spark, TREE)[1, 4]
    assert r["formatted"].count(chat.END) == len(r["turns"]) and r["formatted"].count("<s>") == 1 and "[INST]" not in r["formatted"]


def test_a_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(70)]
    r = formatted(spark, rows)[1, 69]
    assert [t["text"] for t in r["turns"]] == [f"t{i}" for i in range(70)] and r["path_score"] == 70


def test_conversations_with_repeated_turns(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: len(r["turns"]) for r in chat.read_back(chat.format_paths(chat.chains(d))).collect()}
    assert got == {1: 3, None: 1}


def test_no_conversations(spark):
    assert formatted(spark, []) == {}

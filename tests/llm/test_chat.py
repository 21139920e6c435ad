import hashlib

from recollect.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)


CHOSEN = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "éa"), (1, 3, "assistant", "good"), (2, 0, "user", "same"), (3, 0, None, None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (4, 0, "user", "only here"), (None, 0, "user", "lost"), (5, 5, "user", "a<|im_end|>"), (5, 9, "assistant", "b")]
REJECTED = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "éa"), (1, 3, "assistant", "bad one"), (1, 4, "user", "why"), (2, 0, "user", "same"), (3, 0, "user", ""), (3, 1, "assistant", "y"), (5, 5, "user", "a<|im_end|>"), (5, 8, "assistant", "b")]


def brute(side):
    turns = {}
    for c, t, role, text in side:
        turns.setdefault(c, {}).setdefault(-1 if t is None else t, []).append((role or "user", text or ""))
    return {c: {t: sorted(ms) for t, ms in own.items()} for c, own in turns.items()}


def check(spark, chosen, rejected):
    a, b = brute(chosen), brute(rejected)
    got = {r.conv_id: r for r in chat.assemble(chat.format_preferences(frame(spark, chosen), frame(spark, rejected))).collect()}
    assert set(got) == set(a) | set(b)
    show = lambda x: "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '<| im_end |>')}<|im_end|>\n" for ms in x for r, t in ms)
    for c, r in got.items():
        left, right = a.get(c, {}), b.get(c, {})
        first = min((t for t in {*left, *right} if left.get(t) != right.get(t)), default=1 << 60)
        assert r.prompt == show(v for t, v in sorted(left.items()) if t < first)
        assert r.chosen == show(v for t, v in sorted(left.items()) if t >= first)
        assert r.rejected == show(v for t, v in sorted(right.items()) if t >= first)
        for text, spans, side in ((r.chosen, r.chosen_loss, left), (r.rejected, r.rejected_loss, right)):
            masked = [text[s["from"] : s["from"] + s["length"]] for s in spans]
            assert masked == [f"{t}<|im_end|>" for k, ms in sorted(side.items()) if k >= first for role, t in ms if role == "assistant"]


def test_prefix_is_rendered_once(spark):
    check(spark, CHOSEN, REJECTED)


def test_long_conversations_and_very_long_texts(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(4_500)]
    other = [(c, t, r, "else" if t == 3_333 else x) for c, t, r, x in turns if t != 4_000]
    check(spark, turns + [(2, 0, "user", "é" * 400_000)], other + [(2, 0, "user", "é" * 400_000), (2, 1, "assistant", "x" * 300_000)])


def test_digests(spark):
    rows = CHOSEN + [(8, k, ("user", "assistant")[k % 2], f"reply {k}") for k in range(40)]
    got = chat.digests(frame(spark, rows)).collect()
    assert sum(r.part in ("prompt", "chosen") for r in got) == len(rows)
    ends = {r.conv_id: r.turn for r in got if r.part == "rejected"}
    assert set(ends) == {1, 3, 5, 8}
    want = min((k for k in range(1, 40, 2)), key=lambda k: hashlib.md5(f"8:{k}".encode()).hexdigest())
    assert ends[8] == want
    for c, end in ends.items():
        assert all((r.turn < end) == (r.part == "prompt") for r in got if r.conv_id == c)
    cut = next(r for r in got if r.part == "rejected" and r.conv_id == 8)
    half = f"reply {want}"[: len(f"reply {want}") // 2]
    assert cut.rendered_sha256 == hashlib.sha256(f"<|im_start|>assistant\n{half}<|im_end|>\n".encode()).hexdigest() and cut.loss_chars == len(half) + 10
    assert chat.digests(frame(spark, CHOSEN).limit(0)).count() == 0

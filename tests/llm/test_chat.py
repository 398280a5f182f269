import hashlib
import random

from tolmark.llm import chat


def test_escapes_are_reversible():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("<|\\n\nx") for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in out.items():
        turns.sort(key=lambda x: x[:2])
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        shown = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for _, _, r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (conv, len(turns), sha(said), len(learnt), sha(learnt), len(shown))
    return out


def test_round_trip(spark):
    long = "word <|im_end|> é\U0001f642 " * 4000
    rows = [*chat.HOSTILE, (1, 2, "assistant", "b"), (1, 1, "user", None), (1, 3, None, "<\\|x"), (1, None, "system", ""), (2, 1, "assistant", long), (2, 2, "user", long), (2, 3, "assistant", long), (None, 1, "assistant", "null id"), (3, 1, "a\nb\\|<|", "\n<|endoftext|>"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "'x' AS loss")
    for chunk in (1, 500, chat.CHUNK):
        got = {r[0]: tuple(r) for r in chat.read_back(chat.format_chat(df, chunk=chunk)).collect()}
        assert got == expected(rows)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0

"""Rendered dialogues and masks against plain Python."""

from tesseraql.llm import chat


def brute(rows, block):
    out = {}
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, role or "unknown", (text or "").replace("<|", "<¦").replace("|>", "¦>")))
    for conv, turns in talks.items():
        for who in {r for _, r, _ in turns} - {"system"} or {None}:
            for part in {-1 << 40 if t is None else t // block for t, _, _ in turns}:
                mine = sorted((x for x in turns if (-1 << 40 if x[0] is None else x[0] // block) == part), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
                for piece, at in enumerate(range(0, len(mine), block)):
                    text, spans = "", []
                    for _, role, said in mine[at : at + block]:
                        text += "<|im_start|>" + ("system" if role == "system" else "assistant" if role == who else f"user name={role}") + "\n"
                        start = len(text)
                        text += said + "<|im_end|>"
                        if role == who:
                            spans.append((start, len(text)))
                        text += "\n"
                    out[conv, who, part, piece] = (len(mine[at : at + block]), text, spans)
    return out


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> é"), (1, 2, "bob", "Hello"), (1, 3, "cy", "😀 hey"), (1, 4, "ann", None), (1, 4, "ann", None), (2, 0, "system", "alone"), (3, None, None, "who"), (3, 0, "ann", "x" * 50_000), (None, 1, "ann", "y"), (None, 2, "bob", "z")]
    rows += [(9, n, "ann" if n % 3 else "bob", f"turn {n}") for n in range(1000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, participant string").repartition(4)
    for block in (256, 4):
        got = {(r.conv_id, r.participant, r.part, r.piece): (r.n_turns, r.rendered, [tuple(s) for s in r.mask]) for r in chat.rotate(df, block=block).collect()}
        assert got == brute(rows, block)
    assert chat.rotate(df.limit(0)).count() == 0


def test_equal_and_missing_turn_numbers(spark):
    """However turns are numbered, no row holds more than a block of them."""
    rows = [(1, 5, "ann" if n % 2 else "bob", f"said {n % 700}") for n in range(5000)] + [(None, None, "cy", "same words")] * 3000 + [(2, None, "dee", f"x{n}") for n in range(2000)] + [(3, n, "ann", "few") for n in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = chat.rotate(df).collect()
    assert max(r.n_turns for r in found) <= 256
    assert {(r.conv_id, r.participant, r.part, r.piece): (r.n_turns, r.rendered, [tuple(s) for s in r.mask]) for r in found} == brute(rows, 256)

"""Texts with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, block string, part string, node string, kept string"


def words_of(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "té"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, one long word, a long text, repeats, ties and unusual characters."""
    long_text = words_of(1, 4000)
    copied = words_of(2, 120)
    near = copied.split()
    near[50] = "changed"
    return [
        (None, None), (None, "a null id with some words"), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "x" * 30_000),
        (6, long_text), (7, copied), (8, copied), (9, " ".join(near)), (10, words_of(3, 80) + "\n" + words_of(2, 60) + "\n" + words_of(3, 80)),
        (11, "ab " * 400), (11, "ab " * 400), (12, "<|endoftext|> <s> and </s> ▁ <0x0A>"), (13, "Straße ﬁ Ⅳ 中文文本 🙂 é\n\n  two  spaces   end"),
        (14, "12345 %%% &&& ### 67890"), (15, long_text), (-7, words_of(4, 90)), (2**62, words_of(5, 70)),
    ]

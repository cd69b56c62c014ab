"""Small documents with what operators trip over: nulls, empty and long texts, colliding words, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, rank int"

_rnd = random.Random(7)
_WORDS = ["the", "of", "and", "thing", "ouble", "thndre", "erhast", "ännung", "élémen", "señor", "it's", "x1y2", "foo_bar", "—", "日本"]


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + str(r.randrange(40)) for _ in range(n))


def twins() -> tuple[str, str]:
    """Two words that polynomial hashes modulo 2**64 do not tell apart, whatever the base (the sequence of Thue and Morse)."""
    one = "".join("ab"[k.bit_count() & 1] for k in range(2048))
    return one, one.translate(str.maketrans("ab", "ba"))


def documents() -> list[tuple]:
    base, passage = words(120, 1), words(60, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "one", "two words", "***", "日本語", base, base, " ".join(near), base.upper(),
        f"{words(40, 3)} {passage} {words(30, 4)}", f"{words(20, 5)} {passage}", f"é{passage}é", words(5000, 6), "ab" * 3000, "a" * 1000,
        "the end <|endoftext|> of", "\x00\x85\xa0 odd \x1c space", "line\nline\nline\nother", words(12, 8), words(12, 8),
    ]
    rows = [(k, x, "en" if k % 2 else "de", "src0", 0, f"id{k}", "clash", k) for k, x in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "no id at all", None, None, None, None, None, None))
    return rows

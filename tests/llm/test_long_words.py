"""op7 on long words whose polynomials modulo a power of two are equal."""

import numpy as np

from newsmill.llm import window_repeats
from newsmill.llm.winnow import BYTE_CODES, Hashes, word_units


def thue_morse(size, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(size))


def test_word_codes():
    text = f"{thue_morse(4096, 'a', 'b')} {thue_morse(4096, 'b', 'a')}".encode()
    data = np.frombuffer(text, np.uint8)
    plain = Hashes(BYTE_CODES[data]).of(np.array([0, 4097]), np.array([4096, 8193]))
    assert plain[0] == plain[1]
    codes, bounds = word_units(data, np.array([0, len(data)]))
    assert codes[0] != codes[1] and bounds.tolist() == [0, 2]
    # a code depends on the word alone, wherever it stands
    moved = np.frombuffer(b"x " + text + b" y", np.uint8)
    assert word_units(moved, np.array([0, len(moved)]))[0][1:3].tolist() == codes.tolist()


def test_windows_differ_in_one_long_word(spark):
    left, right = (" ".join(f"{c}{i}" for i in range(17)) for c in "lr")
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, f"{left} {a} {right}"), (2, f"{left} {b} {right}"), (3, f"{left} {a} {right} more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in window_repeats.remove_windows(df, with_kept=False).collect()}
    assert got == {1: 35, 2: 0, 3: 35}

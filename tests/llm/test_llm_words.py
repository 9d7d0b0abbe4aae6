"""Words of texts laid end to end."""

import random

import numpy as np

from duebook.llm import words


def test_texts_laid_out():
    rng = random.Random(10)
    given = [b"", b"  ", b"one", b" two\tthree\n\nfour ", "é\x00 \x00é e\x0c".encode(), b"x " * 50]
    given += [b" ".join(rng.choice([b"a", b"ab", b"ba", b"a\x00", b"b" * 40]) for _ in range(90))]
    laid = words.Texts(given)
    flat = [w for t in given for w in t.split()]
    each = np.arange(len(flat))
    assert laid.words(each, np.ones_like(each)) == flat
    assert laid.ends.tolist() == np.cumsum([len(t.split()) for t in given]).tolist()
    assert len(set(zip(flat, laid.hashes.tolist()))) == len(set(flat))
    assert len(set(laid.hashes.tolist())) == len(set(flat))
    assert laid.words(np.array([1]), np.array([3])) == [b"two three four"]
    assert len(words.Texts([]).hashes) == 0 and len(words.Texts([b"", b" "]).hashes) == 0
    number, spellings = laid.numbered()
    assert [spellings[k] for k in number] == flat and len(set(spellings)) == len(spellings)
    assert laid.owners().tolist() == [k for k, t in enumerate(given) for _ in t.split()]


def test_pieces_and_colliding_hashes():
    laid = words.Texts([b"a b,c", b"", b"d,,e  f"], bytes.maketrans(b",", b"\n"))
    assert np.unique(laid.pieces(), return_counts=True)[1].tolist() == [2, 1, 1, 2]
    laid.hashes[:] = 7
    number, spellings = laid.numbered()
    assert [spellings[k] for k in number] == [b"a", b"b", b"c", b"d", b"e", b"f"]


def test_long_words_with_equal_polynomials():
    """Words of the Thue-Morse kind agree in every polynomial modulo 2^64."""
    a = b"a"
    for _ in range(11):
        a += bytes(ord("a") + ord("b") - c for c in a)
    b = bytes(ord("a") + ord("b") - c for c in a)
    laid = words.Texts([a, b, a])
    assert laid.hashes[0] == laid.hashes[2] != laid.hashes[1]

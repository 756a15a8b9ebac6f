"""A piece is looked for only as far back as longer pieces end alike; words are remembered in two generations."""

from framelake.llm import piece_codec
from framelake.llm.vocab import default_path

TEXT = "international zzqxjwvkzzqxjwvk información Straßenbahnhaltestelle naïve 1234567 x  yy 世界 --- " * 2


class Asked(dict):
    seen = ()

    def __contains__(self, piece):
        self.seen.append(piece)
        return super().__contains__(piece)


def test_only_ends_of_pieces_are_lengthened(monkeypatch):
    path = default_path("piece_bpe_32k.model")
    codec, counted = piece_codec.Lattice(path), piece_codec.Lattice(path)
    want = codec.encode(piece_codec.escaped(TEXT))
    ends = {p[k:] for p in counted.ids for k in range(1, len(p))}
    counted.ids = Asked(counted.ids)
    counted.ids.seen = []
    monkeypatch.setattr(piece_codec, "WORDS", 4)
    for _ in range(2):
        assert counted.encode(piece_codec.escaped(TEXT)) == want
    assert counted.ids.seen and all(len(p) == 1 or p[1:] in ends for p in counted.ids.seen)
    assert len(counted.words) <= 3 and len(counted.words.older) <= 3
    assert piece_codec.decoded(piece_codec.pieces_of(path), want) == TEXT

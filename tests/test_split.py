"""Nexus files in byte ranges against the parser of whole texts."""

import random

import pytest

from haploweave.sources import split
from haploweave.sources.nexus import parse, rows_of

PLAIN = "#NEXUS\n[a ; comment ' here]\nBegin Taxa; Dimensions NTax=4; TaxLabels 'b [x] b' a \"c;c\" none; End;\nBEGIN CHARACTERS;\nFormat Datatype=DNA Missing=? Gap=- MatchChar=.;\nMatrix\n'b [x] b' ACGT[;']ACGT\na .C[\nlong]..\n....\n\"c;c\" ....TT..\nextra A-G?\n  ACGT\n;\nEnd;\nBegin Trees; Tree t = ('a;b'); End;\n"
INTERLEAVED = "#nexus\r\nbegin data;\r\nformat datatype=standard match=x;\r\nmatrix [first]\r\n" + "".join(f"t{i} {'01x0'[: 4 if i else 2]}{'' if i else '10'}\r\n" for i in range(9)) + "\r\n" + "".join(f"'t{i}' 1.1\r\n" for i in range(9)) + ";\r\nend;\r\n"
ALONE = "#NEXUS Begin data; Matrix ü ACGT\nö A\nCGT\n; End;"


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_ranges_against_whole_texts(spark, tmp_path, size):
    texts = {"plain": PLAIN, "inter": INTERLEAVED, "alone": ALONE.replace("NEXUS ", "NEXUS\n")}
    for name, text in texts.items():
        (tmp_path / f"{name}.nex").write_text(text, newline="", encoding="utf-8")
    found = sorted(map(tuple, split.read_characters(spark, str(tmp_path), size).collect()))
    assert found == sorted(r for name, text in texts.items() for r in rows_of("characters", name, parse(text)))


def test_states_at_borders():
    rng = random.Random(2)
    for _ in range(300):
        data = "".join(rng.choices("ab'\"[];\n", [4, 2, 1, 1, 1, 1, 1, 1], k=60)).encode()
        cut, state = sorted(rng.sample(range(60), 3)), 0
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, 60], strict=True)]
        whole, ends, at = b"", [], 0
        for p in parts:
            whole += split.without_comments(p, state)
            ends += [at + a for k, a, b in list(split.spans(p, state))[:-1] if k == 0]
            state, at = split.final_state(p, state), at + len(p)
        assert whole == split.without_comments(data, 0) and state == split.final_state(data, 0)
        assert ends == [a for k, a, b in list(split.spans(data, 0))[:-1] if k == 0]


@pytest.mark.parametrize(("text", "said"), [("Begin data; Matrix a A\n; End;", "No Nexus header"), ("#NEXUS\nBegin taxa; taxlabels a; end;", "CHARACTERS or DATA"), ("#NEXUS\nBegin data; Matrix a\n; End;", "No sequence found")])
def test_broken_files(spark, tmp_path, text, said):
    (tmp_path / "x.nex").write_text(text)
    with pytest.raises(Exception, match=said):
        split.read_characters(spark, str(tmp_path), 1 << 20).collect()

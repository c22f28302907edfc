"""Stems against the sample vocabulary that is published with the algorithm, and its special cases."""

from __future__ import annotations

from jobloom.functions.stemming import with_stems

# The published sample (word and stem).
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"""
# Rules that the sample does not reach.
CASES = """skies sky dying die news news generate generat generous generous communication communic arsenal arsenal ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri
falling fall sky sky by by say say happily happili relational relat conditional condit valency valenc hesitancy hesit digitizer digit analogousli analog vietnamization vietnam operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl apology apolog triplicate triplic formative format formalize formal electricity electr electrical electr
goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homologou
activate activ angularity angular homologous homolog effective effect bowdlerize bowdler rate rate controlling control rolled roll proceed proceed exceeds exceed innings inning agreed agre feed feed engineers engin
engineering engin experience experi databases databas a a ox ox 3s 3s yes yes youth youth sayings say abilities abil"""


def pairs(text):
    words = text.split()
    return dict(zip(words[::2], words[1::2], strict=True))


def test_published_sample(spark):
    for text in (SAMPLE, CASES):
        want = pairs(text)
        rows = with_stems(spark.createDataFrame([(w,) for w in want], "word string")).collect()
        assert {r.word: r.term for r in rows} == want


def test_null(spark):
    assert with_stems(spark.createDataFrame([(None,), ("",)], "word string")).select("term").collect() == [(None,), ("",)]

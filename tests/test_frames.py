"""Clauses, references, events and adjudication on sentences of our own."""

from lectern.operators import evidence as V
from lectern.operators import frames as R
from lectern.sources import markup

PEOPLE = ("沈光", "陸澄", "顧寧")
PLACES = ("臨川", "平陽")


def test_roles_with_polarity_and_spans(spark):
    text = "沈光遂攻臨川。沈光不攻臨川。「沈光攻臨川」。聞沈光卒。沈光將攻臨川。若沈光攻臨川，陸澄還。陸澄令沈光攻臨川。"
    got = R.roles(text, ("沈光",), (), names=(*PEOPLE, *PLACES))
    assert [(o["kind"], o["polarity"]) for o in got] == [("attack", "asserted"), ("attack", "denied"), ("die", "reported"), ("attack", "intended"), ("attack", "supposed")]
    assert text[slice(*got[0]["subject_span"])] == "沈光" and text[slice(*got[0]["object_span"])] == "臨川" and got[0]["quote"] == "沈光遂攻臨川。" and not got[0]["relation_verified"]
    assert [o["polarity"] for o in R.roles(text, ("陸澄",), names=PEOPLE)] == ["supposed", "ordered"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "無"), (4, "")], "k int, t string")
    assert R.observed(df, "k", "t", ("沈光",), PLACES).count() == 4


def test_words_of_another_script():
    words = R.Lexicon(verbs={"seek": ("sought", "seeks")}, denying=("never",), intending=("would",), hearsay=("they say",), prepositions=("for",), spaced=True)
    text = "Ann never sought for gold. They say nothing; Bob seeks gold. they say Ann seeks gold, Bob seeks goldfish."
    got = [(text[slice(*o["subject_span"])], o["polarity"], text[slice(*o["object_span"])]) for o in R.roles(text, ("Ann", "Bob"), lexicon=words, names=("gold",))]
    assert got == [("Ann", "denied", "gold"), ("Bob", "asserted", "gold"), ("Ann", "reported", "gold"), ("Bob", "reported", "goldfish")]


def test_references():
    text = "沈光執顧寧，殺之。沈光令執顧寧，殺之。沈光圍臨川，陸澄擊之。"
    got = R.referents(text, PEOPLE, others=PLACES)
    assert [(o["kind"], text[slice(*o["antecedent"])], text[slice(*o["mention"])]) for o in got] == [("kill", "顧寧", "之"), ("repel", "沈光", "之")]
    assert [text[slice(*o["object_span"])] for o in R.outcomes(text, "臨川", PEOPLE)] == ["沈光"] and R.outcomes("傳言沈光圍臨川，陸澄擊之。", "臨川", PEOPLE) == []
    text = "沈文光至。文光還。「文光死。」"
    assert R.introduced(text, 5, "文光", ("沈文光", "陸澄")) == (0, 3) and R.introduced(text, 5, "文光", ("沈文光", "文光")) == (0, 3)
    assert R.introduced("沈文光，陸文光至。文光還", 9, "文光", ("沈文光", "陸文光")) is None and R.introduced(text, 10, "文光", ("沈文光",)) is None and R.introduced("文光", 0, "文光", ("沈文光",)) is None


def test_captures_executions_and_careers():
    text = "沈光走至平陽，為陸澄所獲。沈光被獲。沈光走至平陽，陸澄還，沈光被獲。"
    got = R.captured(text, ("沈光",), (*PEOPLE, *PLACES))
    assert [o["place_span"] and text[slice(*o["place_span"])] for o in got] == ["平陽", None, None] and len(R.captured(text, ("沈光",), PEOPLE, captor=("陸澄",))) == 1
    text = "二年秋，誅沈光。誅沈光。三年冬，不誅沈光。三年冬，沈光為陸澄所殺。"
    assert [o["date"] for o in R.executed(text, ("沈光",), PEOPLE)] == [{"year": "二", "season": "秋"}, None, {"year": "三", "season": "冬"}]
    text = "沈光，字子明，邑人。拜主簿，遷太守。陸澄拜侍郎。除侍郎。沈光不拜侍郎。沈光乞骸骨。"
    assert [o["office"] for o in R.career(text, "沈光", ("主簿", "太守", "侍郎"), PEOPLE)] == ["主簿", "太守"]
    assert R.other_names(text, "沈光") == ["子明"] and R.other_names(text, "陸澄") == [] and R.other_names("", "沈光") == []
    assert [o["event"] for o in R.departures(text, ("沈光",), PEOPLE)] == ["refusal", "departure"]


def test_motives_and_advice():
    text = "陸澄勸沈光曰：「勿戰。恐失平陽。」沈光遂還。"
    got = R.advice(text, PEOPLE)
    assert (got[0]["speaker"], got[0]["addressee"]) == ("陸澄", "沈光") and [text[slice(*x)] for x in got[0]["reason_spans"]] == ["恐失平陽。"]
    assert R.followed(text, got, PEOPLE) == [True] and R.followed(text.replace("遂", "不"), got, PEOPLE) == [False] and R.followed(text[:-6] + "\n", got, PEOPLE) == [None]
    text = "沈光曰：「吾老，恐誤國。」沈光乃辭官。"
    got = R.motives(text, ("沈光",), ("retire",), ("恐",))
    assert text[slice(*got[0]["reason_span"])] == "吾老，恐誤國。" and text[slice(*got[0]["predicate_span"])] == "辭官" and R.motives(text.replace("乃", "不"), ("沈光",), ("retire",), ("恐",)) == []


def test_every_status_of_adjudication():
    seen = {"kind": "attack", "polarity": "asserted", "subject": "沈光", "object": "臨川", "date": "二年", "reason": "恐"}
    wanted = {"kind": "attack", "subject": "沈光", "object": "臨川", "date": True, "reason": True}
    got = [
        R.adjudicated([], wanted), R.adjudicated([seen | {"reason": None}], wanted), R.adjudicated([seen | {"subject": "陸澄"}], wanted), R.adjudicated([seen | {"date": None}], wanted),
        R.adjudicated([seen | {"object": "平陽"}], wanted), R.adjudicated([seen, seen | {"polarity": "denied"}], wanted), R.adjudicated([seen], wanted),
    ]
    assert tuple(got) == R.STATUSES and R.adjudicated([seen], wanted, pinned=False) == "no_event"


def test_relation_classes_are_told_apart():
    assert len(V.RELATIONS) == 16
    for kind, (asks, _) in V.RELATIONS.items():
        assert kind in V.question_plan("沈光" + asks[0])[2]


def test_titles():
    assert markup.number("三十二") == 32 and markup.number("二千三百") == 2300 and markup.number("卷") is None and markup.number("17") == 17
    assert markup.volume_title("小史卷第三十二上¶", "小史") == (32, "上") and markup.volume_title("<pb:a>小史　卷十", "小史") == (10, None) and markup.volume_title("小史卷上", "小史") is None
    lines = ["東策", "text", "西策", "", "西策", "<pb:x>¶", "東策", "南策"]
    assert markup.declared_titles(lines, ["東策", "西策", "南策"]) == [(1, "東策"), (5, "西策")]

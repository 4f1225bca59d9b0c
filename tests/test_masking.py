import json

import pytest
from pyspark.sql import functions as F

from tablemill.functions.jsontext import MASK, SENSITIVE_KEYS, json_masker
from tablemill.functions.masking import mask_connection_string, mask_json

# (text, what must be left of it): the value after a password word goes up to the semicolon,
# a URI password up to its first @.
CONNECTIONS = [
    ("Host=db7;Uid=app;Password=hunter2;Pooling=off;", "Host=db7;Uid=app;Password=*** MASKED ***;Pooling=off;"),
    ("pwd = a b ; x=1", "pwd=*** MASKED ***; x=1"),
    ("Timeout=5;PASSWORD=q=r", "Timeout=5;PASSWORD=*** MASKED ***"),
    ("mongodb://reader:tr0ub4dor@10.1.2.3:27018/logs", "mongodb://reader:*** MASKED ***@10.1.2.3:27018/logs"),
    ("MongoDB+SRV://w:x.y@rs0.internal", "MongoDB+SRV://w:*** MASKED ***@rs0.internal"),
    ("mongodb://u:p@ss@h:1/db", "mongodb://u:*** MASKED ***@ss@h:1/db"),
    ("Host=db7;Trusted=yes;", "Host=db7;Trusted=yes;"),
    (None, None),
]


def test_connection_strings(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CONNECTIONS)], "i int, c string")
    got = df.orderBy("i").select(mask_connection_string(F.col("c"))).collect()
    assert [r[0] for r in got] == [e for _, e in CONNECTIONS]


def test_strict_connection_strings(spark):
    texts = ["mongodb://u:p@ss@h:1/db", "mongodb://u:p@h", "mongodb://h:1/db", "Server=a;Pwd=b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(texts)], "i int, c string")
    got = df.orderBy("i").select(mask_connection_string(F.col("c"), strict=True)).collect()
    assert [r[0] for r in got] == [
        "mongodb://u:*** MASKED ***@h:1/db",
        "mongodb://u:*** MASKED ***@h",
        "mongodb://h:1/db",
        "Server=a;Pwd=*** MASKED ***",
    ]


BODIES = [
    ('{"password": "x", "username": "admin"}', '{"password":"*** MASKED ***","username":"admin"}'),
    ('{"password":null}', '{"password":"*** MASKED ***"}'),
    ('{"note":"Server=a;Password=b"}', '{"note":"Server=a;Password=b"}'),
    (
        '{"a":{"ConnectionString":"Server=s;Password=p1;"},"l":[{"TOKEN":3},[{"pwd":{}}]]}',
        '{"a":{"ConnectionString":"Server=s;Password=*** MASKED ***;"},'
        '"l":[{"TOKEN":"*** MASKED ***"},[{"pwd":"*** MASKED ***"}]]}',
    ),
    ('{"connectionString":"mongodb+srv://u:p@h"}', '{"connectionString":"*** MASKED ***"}'),
    ('{"v":1.50,"big":12345678901234567890,"e":1E5,"t":true}', None),
    ('{"s":"é\\u0041\\n\\"/"}', '{"s":"éA\\n\\"/"}'),
    ('{"p\\u0061ssword":"x"}', '{"password":"*** MASKED ***"}'),
    ('{"secret":1,"secret":2}', '{"secret":"*** MASKED ***","secret":"*** MASKED ***"}'),
    (' [1, {"apiKey":"k"}]', '[1,{"apiKey":"*** MASKED ***"}]'),
    ('{"s":"\\ud800é","pwd":"\\udfff"}', '{"s":"\\ud800\\u00e9","pwd":"*** MASKED ***"}'),
    ('{"s":"\\ud83d\\ude00"}', '{"s":"😀"}'),
    ("plain words", None),
    ("{'single': 1}", None),
    ("{\"open\": ", None),
    ('{"password":"x"} tail', None),
    ("[NaN]", None),
    ("", None),
    (None, None),
]


def test_json_bodies(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "i int, b string")
    got = df.orderBy("i").select(mask_json(F.col("b"))).collect()
    assert [r[0] for r in got] == [b if e is None else e for b, e in BODIES]


@pytest.mark.parametrize("key", [*SENSITIVE_KEYS, "PASSWORD", "ApiKey"])
def test_every_sensitive_key(key):
    out = json.loads(json_masker()(json.dumps({key: "v", "safe": "visible"})))
    assert out == {key: MASK, "safe": "visible"}


def test_object_under_a_sensitive_key():
    out = json.loads(json_masker()('{"secret":{"x":"Server=a;Pwd=b"}}'))
    assert "Pwd=*** MASKED ***" in out["secret"] and "b\"" not in out["secret"]


def test_too_deep_text_is_left_alone():
    deep = "[" * 100000
    assert json_masker()(deep) == deep

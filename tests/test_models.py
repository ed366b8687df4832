import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quillveil.functions import adapters, model_output
from quillveil.functions.recognise import Gazetteers
from quillveil.plans import hybrid
from quillveil.sources import gazetteers


def test_answers_in_all_forms():
    read = model_output.entities_of
    one = [("name", "Ann")]
    for raw in ('[{"category":"Name","value":"Ann"}]', '```json\n{"pii":[{"label":"name","entity":"Ann"}]}\n```', 'x {"data":{"results":{"type":"PIICategory.NAME","text":"Ann"}}} y', '{"NAME":"Ann"}', '{"entities":{"name":["Ann",1]}}'):
        assert read(raw) == one, raw
    assert read('{"pii":[{"category":"name","value":"A"},{"category":"date of-birth","value":"B"},{"category":"x","value":"C"},7]}') == [("name", "A"), ("date_of_birth", "B")]
    for raw in (None, "", "none", "{", "[", "{}", '{"a":1}'):
        assert read(raw) == []
    for raw in (None, "none", "{", "[", '{"a":1}'):
        with pytest.raises(model_output.ExtractionError):
            read(raw, fail=True)
    assert read("{}", fail=True) == []


def test_extraction_policy():
    answers = iter(["broken", '{"name":"Ann"}'])
    assert model_output.extract(lambda: next(answers), fail=True) == [("name", "Ann")]
    asked = []
    assert model_output.extract(lambda: asked.append(1) or "broken") == [] and len(asked) == 1
    with pytest.raises(model_output.ExtractionError):
        model_output.extract(lambda: asked.append(1) or "broken", fail=True)
    assert len(asked) == 3

    def down():
        raise OSError("down")

    assert model_output.extract(down) == []
    with pytest.raises(model_output.ExtractionError):
        model_output.extract(down, fail=True)


def test_prompt_and_grammar(spark):
    system, user = model_output.prompt('say "hi"', ["name"])
    assert user.endswith('"""\nsay "hi"\n"""') and '"name"' in user and system
    row = spark.createDataFrame([("a\n\"b\"",), (None,)], "t string").select(model_output.prompt_column(F.col("t")).alias("p")).select(model_output.last_block(F.col("p.user"))).collect()
    assert [r[0] for r in row] == ['a\n"b"', ""]
    g = model_output.grammar(["name", "tfn"])
    assert g.splitlines()[0].startswith("root ::=") and r'"\"name\"" | "\"tfn\""' in g and len(g.splitlines()) == 6


class _Server(BaseHTTPRequestHandler):
    seen: list = []
    plan: list = []

    def _say(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self._say(200, {})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body))
        self._say(*(self.plan.pop(0) if self.plan else (200, {})))

    def log_message(self, *a):
        pass


def test_http_adapters():
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    try:
        _Server.plan[:] = [(500, {}), (500, {}), (200, {"ok": 1})]
        assert adapters.post(url, {}, wait=waits.append) == {"ok": 1} and waits == [0.1, 0.2]
        _Server.plan[:] = [(500, {})] * 2
        with pytest.raises(OSError):
            adapters.post(url, {}, retries=2, wait=waits.append)
        _Server.plan[:] = [(200, {"message": {"content": "A"}}), (404, {}), (200, {"response": "B"})]
        chat = adapters.ChatHttp(url, retries=1)
        assert [chat.complete("s", "u") for _ in range(2)] == ["A", "B"] and _Server.seen[-1][0] == "/api/generate" and _Server.seen[-1][1]["prompt"] == "u"
        _Server.plan[:] = [(200, {"choices": [{"message": {"content": "C"}}]}), (200, {"content": "D"}), (200, [{"generated_text": "E"}])]
        many = adapters.CompletionsHttp(url, "m", "key")
        assert many.complete("s", "u") == "C" and adapters.GrammarHttp(url).complete("s", "u", "root ::= x") == "D" and _Server.seen[-1][1]["grammar"] == "root ::= x"
        assert adapters.InferenceHttp(url, "m").complete("s", "u") == "E"
        assert many.healthy() and not adapters.CompletionsHttp("http://127.0.0.1:9", "m").healthy()
        assert adapters.choose_narrative("auto", many, chat)[0] == "batching" and adapters.choose_narrative("auto", adapters.CompletionsHttp("http://127.0.0.1:9", "m"), chat)[0] == "chat"
    finally:
        server.shutdown()
    assert adapters.choose_narrative() == ("disabled", None) and adapters.choose_narrative("what") == ("disabled", None)

    def missing():
        raise FileNotFoundError("no files")

    assert adapters.choose_spans("tuned", {"tuned": missing, "base": lambda: adapters.ScriptedSpans({})}, "base")[0] == "base"
    with pytest.raises(ModuleNotFoundError):
        adapters.TokenClassifier("x").predict("text")
    with pytest.raises(ModuleNotFoundError):
        adapters.PromptedSpans("x").predict("text")


def test_narrative_adapter():
    model = adapters.Narrative(adapters.Scripted(lambda user: '{"pii":[{"category":"name","value":"Ann"},{"category":"tfn","value":"7"}]}'), max_chars=20)
    assert model.predict("Ann, Ann 7") == [("private_person", 0, 3, "Ann", 1.0), ("private_person", 5, 8, "Ann", 1.0), ("account_number", 9, 10, "7", 1.0)]
    assert model.predict("") == [] and model.predict("Ann " * 9) == []


KNOWN = Gazetteers(["Blue Gum Bank"], {"BGB": "Blue Gum Bank"}, {"Glebe": {"NSW"}}, {"2037": {("Glebe", "NSW")}})


def test_hybrid(spark):
    texts = [
        (1, "Jane Citizen at Blue Gum Bank, Glebe 2037"), (2, "account 999 999 999 TFN: 123 456 789"), (3, None), (4, ""), (5, "Jane Citizen, jane@x.org"), (6, "the patient Jane Citizen wrote"),
        (7, "handle tw_brian740 here"), (8, "PA1234567. and 062-000."),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, spans string")
    ner = adapters.ScriptedSpans({"Jane Citizen": ("private_person", 0.9), "999 999 999": ("account_number", 0.95), " jane@x.org ": ("private_email", 0.1), "tw_brian740": ("private_person", 0.9), "PA1234567.": ("account_number", 0.9)})

    def run(model, **more):
        got = hybrid.hybrid_table(hybrid.with_candidates(docs, model), gazetteers=KNOWN, style="category", keep_values=True, **more).collect()
        return {r["document_id"]: r for r in got}

    got = run(ner, floor=0.5)
    assert got[1]["redacted_text"] == "[REDACTED_NAME] at [REDACTED_ORGANISATION], [REDACTED_LOCATION] [REDACTED_LOCATION]" and not got[1]["needs_review"]
    assert got[2]["needs_review"] and "999" not in got[2]["redacted_text"] and "789" not in got[2]["redacted_text"]
    assert got[3]["redacted_text"] == got[4]["redacted_text"] == "" and got[3]["pii_count"] == 0
    assert got[5]["redacted_text"] == "[REDACTED_NAME], [REDACTED_EMAIL]" and got[7]["redacted_text"] == "handle [REDACTED_USERNAME] here"
    # a shape has no check to pass, so the model's longer span wins
    assert got[8]["redacted_text"] == "[REDACTED_GENERIC_ID] and [REDACTED_BSB_ACCOUNT]."
    # a model that fails leaves what patterns find
    class Fails:
        name = "fails"

        def predict(self, text):
            raise RuntimeError("no memory")

    floor = run(Fails())
    assert floor[5]["redacted_text"] == "Jane Citizen, [REDACTED_EMAIL]" and floor[1]["redacted_text"].endswith("[REDACTED_LOCATION]")
    bare = run(ner, use_patterns=False)
    assert bare[5]["redacted_text"] == "[REDACTED_NAME], jane@x.org"
    off = run(None, organisations=False, locations=False, username=False)
    assert off[1]["pii_count"] == 0 and off[7]["redacted_text"] == "handle [REDACTED_USERNAME] here"
    assert hybrid.hybrid_table(hybrid.with_candidates(docs.limit(0), ner)).count() == 0


def test_narrative_gate(spark):
    docs = spark.createDataFrame([(1, "the patient Jane slept"), (2, "Jane slept")], "doc_id long, text string")
    model = adapters.Narrative(adapters.Scripted(lambda user: '{"name":"Jane"}'))
    both = hybrid.with_narrative(hybrid.with_candidates(docs, None), model)
    got = {r["document_id"]: r["redacted_text"] for r in hybrid.hybrid_table(both, style="category").collect()}
    assert got == {1: "the patient [REDACTED_NAME] slept", 2: "Jane slept"}
    stats = hybrid.gate_stats(both).first()
    assert (stats["invocations"], stats["skips"], stats["invoke_rate"]) == (1, 1, 0.5) and hybrid.gate_stats(both.limit(0)).first()["invoke_rate"] == 0.0


def test_gazetteer_files(spark, tmp_path):
    files = {"names": "# c\nBlue Gum Bank\n\n", "acronyms": "BGB\tBlue Gum Bank\tbank\nNOPE\n", "suburbs": "Glebe|NSW, VIC\nPark\n", "codes": "2037|Glebe:NSW,Forest Lodge:NSW\nbad\n2000|x\n"}
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    g = gazetteers.gazetteers(gazetteers.read_list(spark, str(tmp_path / "names")), gazetteers.read_acronyms(spark, str(tmp_path / "acronyms")), gazetteers.read_suburbs(spark, str(tmp_path / "suburbs")), gazetteers.read_postcodes(spark, str(tmp_path / "codes")))
    assert g == Gazetteers(["Blue Gum Bank"], {"BGB": "Blue Gum Bank"}, {"Glebe": {"NSW", "VIC"}, "Park": set()}, {"2037": {("Glebe", "NSW"), ("Forest Lodge", "NSW")}})
    with pytest.raises(ValueError):
        Gazetteers(["x"] * (Gazetteers.LIMIT + 1))

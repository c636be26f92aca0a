import pytest
import yaml
from pydantic import ValidationError

from flowtide.plans.config import load_config
from flowtide.sources.contract import DEFAULT, Contract, load_contract
from flowtide.sources.flows import FIELDS


def test_default_names_the_canonical_fields():
    c = load_contract()
    assert c.field_map(f.name for f in FIELDS) == {f.name: f.default for f in FIELDS}
    assert c.compare([*(x.raw for x in c.columns[1:]), "extra"]) == ([c.columns[0].raw], ["extra"])
    assert len(c.to_markdown().split("\n| `")) == len(c.columns) + 1


def test_project(spark):
    raw = spark.createDataFrame([("10.0.0.1", "443", "x"), (None, "n/a", "y")], "src_id_addr string, dist_port string, other string")
    out = load_contract().project(raw)
    assert len(out.columns) == len(load_contract().columns) and dict(out.dtypes)["dst_port"] == "int"
    assert [tuple(r) for r in out.select("src_ip", "dst_port", "bytes").collect()] == [("10.0.0.1", 443, None), (None, None, None)]


def test_refused():
    data = yaml.safe_load(DEFAULT.read_text())
    with pytest.raises(ValidationError, match="twice"):
        Contract.model_validate(data | {"columns": data["columns"] + data["columns"][:1]})
    with pytest.raises(ValidationError, match="low confidence"):
        Contract.model_validate(data | {"columns": [data["columns"][0] | {"use": "feature", "confidence": "low"}]})


def test_config_reads_a_contract(tmp_path):
    column = {"raw": "sender", "name": "src_ip", "type": "string", "use": "entity", "confidence": "high", "meaning": "who sends"}
    (tmp_path / "mine.yaml").write_text(yaml.safe_dump({"version": 1, "name": "mine", "columns": [column, column | {"raw": "n", "name": "bytes", "type": "bigint"}]}))
    (tmp_path / "c.yaml").write_text("inputs: [a]\noutput: o\ncontract: mine.yaml\nfield_map: {bytes: octets}")
    assert load_config(str(tmp_path / "c.yaml")).mapping() == {"src_ip": "sender", "bytes": "octets"}

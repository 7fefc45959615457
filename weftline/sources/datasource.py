"""The ``plan_responses`` data source: extraction plans as a batch table, one partition for each plan and config."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.extraction import PlanRunner, TokenCache, http_transport, replay
from weftline.sources.jmespath import JmesError

SCHEMA = (
    "tenant_id string, integration string, plan_key string, config_id string, execution_id string, step_path string, request_url string, request_method string, "
    "status_code int, response_body string, response_headers map<string,string>, response_size long, duration_ms long, extracted_data string, error string"
)


class PlanResponses(DataSource):
    """Options: plans (JSON list), configs (JSON list), tenant_id, recorded (JSON list of responses), recorded_path (Parquet
    of them in a folder that tasks can read: config_id, url, body as JSON text; each task reads those of its config; without either
    HTTP is used), contexts (JSON object: "plan key/config id" -> what set_context kept in the run before).

    A plan's ``auth`` ({id, plan, token_path, header?, format?, ...}) is run first, and its token sent with every request; a flow
    that fails gives one error row. With ``emit_context`` a plan's last row (step_path "context") holds what set_context kept.
    """

    @classmethod
    def name(cls) -> str:
        return "plan_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _recorded(path: str, config_id: str) -> list[dict]:
    """Responses of one config, read where the plan runs."""
    from pyarrow import dataset

    from weftline.sources.event_log import _store

    store, root = _store(path)
    own = dataset.dataset(root, filesystem=store, format="parquet").to_table(["url", "body"], filter=dataset.field("config_id") == config_id)
    return [{"url": r["url"], "body": json.loads(r["body"])} for r in own.to_pylist()]


class _Part(InputPartition):
    def __init__(self, plan: dict, config: dict, execution_id: str):
        self.plan, self.config, self.execution_id = plan, config, execution_id


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tenant, self.recorded, self.recorded_path = options.get("tenant_id", ""), options.get("recorded"), options.get("recorded_path")
        self.contexts = json.loads(options.get("contexts", "{}"))
        self.plans, self.configs = json.loads(options.get("plans", "[]")), json.loads(options.get("configs", "[{}]"))

    def partitions(self) -> list[_Part]:
        return [_Part(p, c, uuid.uuid5(uuid.NAMESPACE_OID, f"{p.get('key')}/{c.get('id')}").hex) for p in self.plans for c in self.configs]

    def read(self, part: _Part) -> Iterator[tuple]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if self.recorded is not None:
            transport = replay(json.loads(self.recorded))
        else:
            transport = http_transport() if self.recorded_path is None else replay(_recorded(self.recorded_path, part.config.get("id")))
        plan, context = part.plan, self.contexts.get(f"{part.plan.get('key')}/{part.config.get('id')}")
        runner = PlanRunner(plan, part.config, transport, self.tenant, part.execution_id, context)
        if flow := plan.get("auth"):
            try:
                token = TokenCache().get(flow, part.config, transport)
            except JmesError as e:
                yield tuple(runner.envelope("auth", None, None, error=str(e))[n] for n in names)
                return
            runner.headers[flow.get("header", "Authorization")] = flow.get("format", "Bearer {}").format(token)
        for e in runner.run():
            yield tuple(e[n] for n in names)
        if plan.get("emit_context"):
            yield tuple(runner.envelope("context", None, None, extracted=runner.context)[n] for n in names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlanResponses)

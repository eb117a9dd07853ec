"""The service estate and fault catalogue as frames.

Fixed values: ids, runtimes, edges and signal levels decide which telemetry a
seed gives, so they are stated as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# id | name | tier | owner_team | runtime   (all in region eu-west-1)
REGION = "eu-west-1"
SERVICES = """
svc-edge-gateway | edge-gateway | 0 | Platform Edge | go1.23
svc-checkout-api | checkout-api | 0 | Commerce | java21
svc-payments-gateway | payments-gateway | 0 | Payments | java21
svc-identity | identity-service | 0 | Identity | go1.23
svc-catalog-api | catalog-api | 0 | Commerce | node20
svc-order-orchestrator | order-orchestrator | 1 | Commerce | java21
svc-inventory | inventory-service | 1 | Supply | go1.23
svc-pricing | pricing-engine | 1 | Commerce | rust1.82
svc-fraud-scoring | fraud-scoring | 1 | Risk | python3.12
svc-notifications | notification-service | 1 | Growth | node20
svc-search-indexer | search-indexer | 2 | Commerce | python3.12
svc-recommendations | recommendation-service | 2 | Growth | python3.12
svc-config | config-service | 2 | Platform Edge | go1.23
svc-orders-db | orders-db | 0 | Data Platform | postgres16
svc-sessions-cache | sessions-cache | 0 | Data Platform | redis7
svc-events-bus | events-bus | 1 | Data Platform | kafka3.8
svc-catalog-search | catalog-search | 2 | Data Platform | opensearch2
svc-analytics-etl | analytics-etl | 3 | Data Platform | python3.12
svc-reporting-batch | reporting-batch | 3 | Data Platform | python3.12
"""

# upstream depends on downstream
DEPENDENCIES = """
svc-edge-gateway | svc-identity | sync
svc-edge-gateway | svc-checkout-api | sync
svc-edge-gateway | svc-catalog-api | sync
svc-edge-gateway | svc-config | sync
svc-identity | svc-sessions-cache | datastore
svc-checkout-api | svc-order-orchestrator | sync
svc-checkout-api | svc-pricing | sync
svc-checkout-api | svc-payments-gateway | sync
svc-checkout-api | svc-sessions-cache | datastore
svc-payments-gateway | svc-fraud-scoring | sync
svc-payments-gateway | svc-orders-db | datastore
svc-order-orchestrator | svc-inventory | sync
svc-order-orchestrator | svc-orders-db | datastore
svc-order-orchestrator | svc-events-bus | async
svc-inventory | svc-orders-db | datastore
svc-pricing | svc-config | sync
svc-catalog-api | svc-catalog-search | sync
svc-catalog-api | svc-pricing | sync
svc-notifications | svc-events-bus | async
svc-search-indexer | svc-events-bus | async
svc-search-indexer | svc-catalog-search | datastore
svc-recommendations | svc-events-bus | async
svc-recommendations | svc-catalog-search | datastore
svc-fraud-scoring | svc-orders-db | datastore
svc-analytics-etl | svc-events-bus | async
svc-analytics-etl | svc-orders-db | datastore
svc-reporting-batch | svc-analytics-etl | async
"""

# id | name | signature | runtimes | severity | runbook
PATTERNS = """
fault-pool-exhaustion | Connection pool exhaustion | db.pool.saturated | postgres16 | 1 | rb-database-connection-pool
fault-cache-stampede | Cache stampede after mass eviction | cache.hit_ratio.collapse | redis7 | 2 | rb-cache-stampede
fault-consumer-lag | Consumer group lag growth | stream.consumer.lag | kafka3.8 | 2 | rb-stream-consumer-lag
fault-memory-leak | Heap growth with escalating pause time | runtime.memory.leak | java21 node20 python3.12 | 2 | rb-memory-pressure
fault-timeout-cascade | Synchronous timeout cascade | dependency.timeout.cascade | go1.23 java21 node20 python3.12 rust1.82 | 1 | rb-timeout-and-retry
fault-cert-expiry | TLS certificate expiry | tls.handshake.failure | go1.23 java21 node20 | 1 | rb-tls-certificate
fault-n-plus-one | Query amplification after deploy | db.queries_per_request.regression | go1.23 java21 node20 python3.12 rust1.82 | 2 | rb-query-amplification
fault-shard-imbalance | Search shard imbalance | search.shard.imbalance | opensearch2 | 3 | rb-search-shard-imbalance
"""

# pattern | role | metric | unit | direction | baseline | peak
SIGNALS = """
fault-pool-exhaustion | primary | db.pool.wait_ms | ms | rise | 2.0 | 4200.0
fault-pool-exhaustion | primary | db.pool.available | count | fall | 40.0 | 0.0
fault-pool-exhaustion | primary | db.active_connections | count | rise | 55.0 | 100.0
fault-pool-exhaustion | secondary | http.server.p99_ms | ms | rise | 180.0 | 9500.0
fault-pool-exhaustion | secondary | http.server.error_rate | ratio | rise | 0.001 | 0.34
fault-cache-stampede | primary | cache.hit_ratio | ratio | fall | 0.94 | 0.11
fault-cache-stampede | primary | cache.evictions_per_s | count | rise | 5.0 | 8800.0
fault-cache-stampede | primary | cache.memory_used_ratio | ratio | rise | 0.62 | 0.99
fault-cache-stampede | secondary | http.server.p99_ms | ms | rise | 150.0 | 3100.0
fault-cache-stampede | secondary | db.active_connections | count | rise | 50.0 | 92.0
fault-consumer-lag | primary | stream.consumer.lag | messages | rise | 400.0 | 1850000.0
fault-consumer-lag | primary | stream.consumer.throughput | msg_per_s | fall | 12000.0 | 900.0
fault-consumer-lag | secondary | pipeline.freshness_lag_s | s | rise | 4.0 | 2400.0
fault-memory-leak | primary | process.memory.rss_mb | MB | rise | 620.0 | 3900.0
fault-memory-leak | primary | runtime.gc.pause_ms | ms | rise | 12.0 | 1450.0
fault-memory-leak | primary | process.restarts | count | rise | 0.0 | 6.0
fault-memory-leak | secondary | http.server.p99_ms | ms | rise | 210.0 | 4300.0
fault-timeout-cascade | primary | http.client.timeout_rate | ratio | rise | 0.0004 | 0.61
fault-timeout-cascade | primary | http.client.p99_ms | ms | rise | 240.0 | 10000.0
fault-timeout-cascade | secondary | http.server.error_rate | ratio | rise | 0.002 | 0.47
fault-timeout-cascade | secondary | thread_pool.queue_depth | count | rise | 3.0 | 480.0
fault-cert-expiry | primary | tls.handshake_failures_per_s | count | rise | 0.0 | 1450.0
fault-cert-expiry | primary | tls.certificate_days_remaining | days | fall | 14.0 | -1.0
fault-cert-expiry | secondary | http.server.error_rate | ratio | rise | 0.001 | 0.98
fault-n-plus-one | primary | db.queries_per_request | count | rise | 3.0 | 87.0
fault-n-plus-one | primary | db.query_rate | qps | rise | 900.0 | 26000.0
fault-n-plus-one | secondary | http.server.p99_ms | ms | rise | 190.0 | 2600.0
fault-n-plus-one | secondary | db.pool.wait_ms | ms | rise | 2.0 | 780.0
fault-shard-imbalance | primary | search.query.p99_ms | ms | rise | 85.0 | 2900.0
fault-shard-imbalance | primary | search.shard.max_docs_ratio | ratio | rise | 1.1 | 6.4
fault-shard-imbalance | secondary | http.server.p99_ms | ms | rise | 160.0 | 1900.0
"""


def rows(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in text.strip().splitlines()]


def services(spark: SparkSession) -> DataFrame:
    data = [
        (i, *r[:2], int(r[2]), *r[3:], REGION) for i, r in enumerate(rows(SERVICES))
    ]
    return spark.createDataFrame(
        data, "position int, id string, name string, tier int, owner_team string, "
        "runtime string, region string",
    )


def dependencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        rows(DEPENDENCIES), "upstream_id string, downstream_id string, kind string"
    )


def patterns(spark: SparkSession) -> DataFrame:
    data = [
        (i, r[0], r[1], r[2], r[3].split(), int(r[4]), r[5]) for i, r in enumerate(rows(PATTERNS))
    ]
    return spark.createDataFrame(
        data, "position int, id string, name string, signature string, runtimes array<string>, "
        "severity int, runbook_id string",
    )


def signals(spark: SparkSession) -> DataFrame:
    data = [
        (i, *r[:5], float(r[5]), float(r[6])) for i, r in enumerate(rows(SIGNALS))
    ]
    return spark.createDataFrame(
        data, "position int, pattern_id string, role string, metric string, unit string, "
        "direction string, baseline double, peak double",
    )

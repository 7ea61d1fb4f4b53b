from workload import audit_q, events_q, intervals_q, joins_q, labels_q, learn_q, machines_q, metrics_q, signal_q, sources_q, streaming_q, windows_q
from workload.registry import REGISTRY as ALL

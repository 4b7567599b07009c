"""All queries for the reference's operators."""

from sparkloom.plans import answers, corpus, files, graph, more, products, scalars, search, sessions
from sparkloom.plans.registry import Registry

REGISTRY = Registry()
for _module in (scalars, search, corpus, products, graph, sessions, answers, files, more):
    REGISTRY.queries |= _module.REGISTRY.queries
    REGISTRY.sql |= _module.REGISTRY.sql

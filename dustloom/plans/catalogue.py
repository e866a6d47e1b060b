"""All queries of the observation operators by name, and their SQL."""

from dustloom.plans import observations, outputs, texts, tracks

QUERIES = {**observations.QUERIES, **texts.QUERIES, **tracks.QUERIES, **outputs.QUERIES}
ORACLE = {**observations.ORACLE, **texts.ORACLE, **tracks.ORACLE, **outputs.ORACLE}

"""Ranking, fusion and evaluation of large pools of scored candidates on Spark."""

"""Arborist: code-structure and documentation analytics over many repositories, on Spark.

Every public function takes DataFrames and returns a lazy DataFrame.  `project`
is a column of every table and part of every key, so one job answers a question
for all repositories at once.
"""

"""Catalogue matching and ranking with Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here runs an action unless its docstring says so.
"""

"""Sablewick: a PySpark-native engine for indexing and searching source trees and text corpora."""

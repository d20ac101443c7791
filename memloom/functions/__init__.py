"""memloom package part."""

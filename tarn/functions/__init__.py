"""See the package docstring in tarn/__init__.py."""

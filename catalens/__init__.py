"""catalens: dataset-level operators for studying a large catalogue of published software components.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is collected on the driver.
"""

__version__ = "0.1.0"

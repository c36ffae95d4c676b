"""Support-desk analytics as Spark DataFrame operators.

Every public function takes DataFrames and returns a DataFrame; nothing is collected to the driver.
"""

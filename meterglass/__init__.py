"""Token-usage analytics on Spark: composable DataFrame transforms over usage logs."""

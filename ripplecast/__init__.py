"""ripplecast: Spark-native analytics for influence over directed social graphs and adoption logs."""

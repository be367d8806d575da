"""PySpark-native operators over ordered, time-coded text records and documents."""

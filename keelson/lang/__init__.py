"""The query, preference and environment languages: tokens, syntax trees and parsers."""

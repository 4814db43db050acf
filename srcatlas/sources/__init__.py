"""Reading project trees and writing results."""
